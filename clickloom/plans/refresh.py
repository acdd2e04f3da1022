"""Bringing the derived tables up to date with one more loaded batch.

New events of sessions whose old events stay as they are get merged into the
stored activity; no old event is read for them. Only where an event id of the
batch has been loaded before, or the batch was loaded before with other events,
may an old session lose or keep an event, so those sessions are recomputed from
events, restricted to the days on which they and their copies lie. The days come
from the stored sessions and from the index of event ids, so no scan goes over
all events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.dedup import dedup_events
from clickloom.operators.filters import keep_keys
from clickloom.plans.build import (
    LAST_SEEN_DAY,
    SESSION_DAY,
    build,
    is_built,
    loaded_batches,
    log_batches,
    place_activity,
    with_last_seen_day,
    with_session_day,
)
from clickloom.plans.context_state import align_contexts, fit
from clickloom.plans.event_index import SOURCE, create_index, day_rows, index_sources, indexed_sources, possible_days
from clickloom.plans.models import (
    SESSION,
    ModelOptions,
    as_activity,
    index_page_views,
    merge_activity,
    model_events,
    page_activity,
    session_rollup,
    sessions,
    users,
)
from clickloom.schema import BATCH_ID, EVENT_DAY
from clickloom.session import Scratch
from clickloom.sources.loading import forget_replaced, replaced_rows
from clickloom.sources.tables import Zones, partition_filter, replace_rows


def refresh(spark: SparkSession, zones: Zones, batch_id: str, options: ModelOptions = ModelOptions()) -> None:
    """Refresh after ``batch_id`` was loaded; the outcome equals that of ``build``.

    A refresh that was interrupted, or is asked for again, recomputes the
    sessions of the batch from events, so no event is counted twice. Batches
    that are loaded but whose turn has not come are left out.
    """
    if not is_built(spark, zones):
        build(spark, zones, options)
        return
    logged = spark.table(zones.batches).select(BATCH_ID)
    waiting = {r[BATCH_ID] for r in loaded_batches(spark, zones).join(logged, BATCH_ID, "left_anti").collect()}
    seen_before = batch_id not in waiting
    log_batches(zones, spark.createDataFrame([(batch_id,)], f"{BATCH_ID} STRING"))
    every = spark.table(zones.events)
    events = model_events(every.where(~F.col(BATCH_ID).isin(sorted(waiting - {batch_id}))), options)
    with Scratch(spark) as scratch:
        batch = scratch.save(events.where(F.col(BATCH_ID) == batch_id), "batch")
        _index_batches(spark, zones, every, {r[BATCH_ID] for r in logged.distinct().collect()}, batch_id)
        align_contexts(spark, zones, events, options)
        gone = replaced_rows(spark, zones.events, batch_id)
        delta = Delta(events, batch, events.where(F.col(BATCH_ID) != batch_id), gone, seen_before)
        refresh_delta(spark, zones, delta, options, scratch)
    forget_replaced(spark, zones.events, batch_id)


def _index_batches(spark: SparkSession, zones: Zones, events: DataFrame, logged: set[str], batch_id: str) -> None:
    """Index the batch, and those of the derived tables that a build has left without an index."""
    create_index(spark, zones)
    missing = sorted(logged - indexed_sources(spark, zones) | {batch_id})
    rows = events.where(F.col(BATCH_ID).isin(missing))
    index_sources(spark, zones, rows.select("event_id", EVENT_DAY, F.col(BATCH_ID).alias(SOURCE)))


@dataclass(frozen=True)
class Delta:
    """What changed in the events: ``events`` are all that count now, of which those of the ``batch`` are
    new and the ``others`` are not, and (event_id, session) of the rows that have ``gone`` since.

    ``seen_before`` says that the derived tables may hold part of it already.
    """

    events: DataFrame
    batch: DataFrame
    others: DataFrame
    gone: DataFrame | None
    seen_before: bool


def refresh_delta(spark: SparkSession, zones: Zones, delta: Delta, options: ModelOptions, scratch: Scratch) -> None:
    """Bring the derived tables from before to after the change. The ids of the batch are indexed already.

    Days are all that is read of old events: those on which the index says that a
    copy may lie, and those on which the stored sessions have their events.
    """
    batch = delta.batch
    batch_sessions = _keys(batch, SESSION)
    ids = batch.select("event_id", SESSION)
    if delta.gone is not None:  # events that are no longer there, in sessions that may have lost them
        ids = ids.unionByName(delta.gone.select("event_id", SESSION))
    ids = scratch.save(ids, "ids")
    index = spark.table(zones.event_index)
    copy_days = day_rows(possible_days(index, ids, ids.count()))
    dirty = _sessions_with_copies(delta.others.where(partition_filter([EVENT_DAY], copy_days)), ids)
    if delta.seen_before or delta.gone is not None:
        lost = ids if delta.seen_before else delta.gone
        dirty = dirty.unionByName(_keys(lost, SESSION)).distinct()
    dirty = scratch.save(dirty, "dirty")
    affected = scratch.save(batch_sessions.unionByName(dirty).distinct(), "affected")

    old_state = scratch.save(
        keep_keys(spark.table(zones.session_state), affected, SESSION, affected.count()), "old_state"
    )
    old_days = old_state.select(SESSION_DAY).distinct().collect()
    old_activity = spark.table(zones.page_activity).where(partition_filter([SESSION_DAY], old_days))
    old_activity = keep_keys(old_activity, old_state.select(SESSION), SESSION, old_state.count())
    old_activity = old_activity.select(*as_activity(batch, options).columns)
    added = dedup_events(batch)
    if dirty.isEmpty():
        fresh = merge_activity(old_activity, added, options)
    else:
        # duplicates within the batch are settled before its dirty sessions are left out
        clean_added = added.join(dirty, SESSION, "left_anti")
        clean_old = old_activity.join(dirty, SESSION, "left_anti")
        days = _days_of(old_state, dirty).unionByName(batch.select(EVENT_DAY)).distinct()
        days = list(dict.fromkeys([*copy_days, *day_rows(days)]))
        recomputed = _recomputed(delta.events, dirty, days, index, scratch, options)
        fresh = merge_activity(clean_old, clean_added, options).unionByName(recomputed)
    fresh = scratch.save(fresh, "activity")

    state = scratch.save(with_session_day(session_rollup(fresh)), "state")
    new_days = state.select(SESSION_DAY).distinct().collect()
    placed = fit(place_activity(index_page_views(fresh, scratch, options), state), spark.table(zones.page_activity))
    replace_rows(zones.page_activity, [SESSION_DAY], placed, affected, SESSION, old_days, new_days)
    _refresh_users(spark, zones, affected, old_state, state, scratch)
    # Last, because an interrupted refresh finds what it has to replace from here.
    state = fit(state, spark.table(zones.session_state))
    replace_rows(zones.session_state, [SESSION_DAY], state, affected, SESSION, old_days, new_days)


def _keys(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def _sessions_with_copies(others: DataFrame, ids: DataFrame) -> DataFrame:
    """Sessions of those event ids, which the batch has or had, that other events hold too.

    Reads two columns of the others.
    """
    copies = keep_keys(others.select("event_id", SESSION), _keys(ids, "event_id"), "event_id", ids.count())
    own = ids.select("event_id", SESSION).join(_keys(copies, "event_id"), "event_id", "left_semi")
    return _keys(copies.unionByName(own), SESSION)


def _days_of(state: DataFrame, dirty: DataFrame) -> DataFrame:
    """Days on which the stored sessions have the events that count in them."""
    spans = state.join(dirty, SESSION, "left_semi").where("first_day IS NOT NULL")
    return spans.select(F.explode(F.sequence("first_day", "last_day")).alias(EVENT_DAY)).distinct()


def _recomputed(
    events: DataFrame, dirty: DataFrame, days: list[Row], index: DataFrame, scratch: Scratch, options: ModelOptions
) -> DataFrame:
    """Activity of the ``dirty`` sessions from all events, which lie on ``days``.

    An event of theirs that does not count now, on another day, is a copy that has
    lost; it would win only if a better one had gone, and then its id is in the
    change and its day among those of the index. Another session may hold a better
    copy of an event, so duplicates are removed over all copies of the event ids in
    these sessions, and only then are the sessions picked.
    """
    on_days = events.where(partition_filter([EVENT_DAY], days))
    inside = scratch.save(keep_keys(on_days, dirty, SESSION, dirty.count()), "dirty_events")
    inside_ids = scratch.save(_keys(inside, "event_id"), "dirty_ids")
    count = inside_ids.count()
    copy_days = day_rows(possible_days(index, inside_ids, count))
    copies = keep_keys(events.where(partition_filter([EVENT_DAY], copy_days)), inside_ids, "event_id", count)
    # a session of NULL is in no dirty one
    outside = copies.join(dirty, SESSION, "left_anti")
    lost = copies.join(dirty, SESSION, "left_semi").where(~partition_filter([EVENT_DAY], days))
    kept = dedup_events(inside.unionByName(outside).unionByName(lost)).join(dirty, SESSION, "left_semi")
    return page_activity(kept, options)


def _refresh_users(
    spark: SparkSession,
    zones: Zones,
    affected: DataFrame,
    old_state: DataFrame,
    state: DataFrame,
    scratch: Scratch,
) -> None:
    """Re-aggregate from sessions the users that had, or now have, an affected session."""
    user = F.col("first_event.domain_userid").alias("domain_userid")
    changed = scratch.save(
        _keys(old_state.select(user).unionByName(state.select(user)), "domain_userid"), "users"
    )
    others = spark.table(zones.session_state).join(affected, SESSION, "left_anti")
    rows = keep_keys(sessions(others).unionByName(sessions(state)), changed, "domain_userid", changed.count())
    fresh = scratch.save(with_last_seen_day(users(rows)), "user_rows")
    stored = spark.table(zones.users).select("domain_userid", LAST_SEEN_DAY)
    old_days = stored.join(changed, "domain_userid", "left_semi").select(LAST_SEEN_DAY).distinct().collect()
    new_days = fresh.select(LAST_SEEN_DAY).distinct().collect()
    replace_rows(zones.users, [LAST_SEEN_DAY], fresh, changed, "domain_userid", old_days, new_days)
