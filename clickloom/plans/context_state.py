"""Contexts of the models that are switched on or off between refreshes.

A context that is on has a column in both state tables. Switching it on adds the
column, which rewrites nothing, and fills it from the events of those days on
which a value or a copy of its event may lie; only days of sessions with a value
are rewritten. Switching it off changes the views alone; what is stored goes
stale and is replaced when the context is switched on again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.dedup import dedup_events
from clickloom.operators.filters import keep_keys
from clickloom.plans.build import SESSION_DAY, context_note, note_contexts, noted_contexts, publish
from clickloom.plans.event_index import day_rows, possible_days
from clickloom.plans.models import ACTIVITY_KEYS, SESSION, ModelContext, ModelOptions, as_activity, combine_activity
from clickloom.schema import EVENT_DAY
from clickloom.session import Scratch
from clickloom.sources.tables import Zones, overwrite_partitions, partition_filter


def align_contexts(spark: SparkSession, zones: Zones, events: DataFrame, options: ModelOptions) -> None:
    """Bring state tables and views in line with the contexts of ``options``.

    ``events`` come from ``model_events`` with the same options; their ids are
    indexed. The note of what is held is written last, so a run that was
    interrupted is repeated. Values of events that the derived tables do not hold
    yet do no harm: their sessions are refreshed, and a minimum stays one.
    """
    held = noted_contexts(spark, zones)
    if held == context_note(options):
        return
    kept = held.split(";")[0].split(",")
    new = [c for c in options.active_contexts if c.state not in kept]
    if new:
        _fill(spark, zones, events, new, options)
    publish(spark, zones, options)
    note_contexts(spark, zones, options)


def fit(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with a typed NULL for every column that only ``table`` has: contexts that are off."""
    missing = [f for f in table.schema if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else rows


def _fill(spark: SparkSession, zones: Zones, events: DataFrame, new: list[ModelContext], options: ModelOptions) -> None:
    states = [c.state for c in new]
    with Scratch(spark) as scratch:
        found = _values(spark, zones, events, new, options, scratch)
        kinds = {f.name: f.dataType.simpleString() for f in found.schema}
        for table, keys in ((zones.page_activity, ACTIVITY_KEYS), (zones.session_state, [SESSION])):
            absent = [s for s in states if s not in spark.table(table).columns]
            if absent:
                spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'{s} {kinds[s]}' for s in absent)})")
            fresh = found.groupBy(*keys).agg(*[F.min(s).alias(s) for s in states])
            _replace(spark, table, keys, fresh, states)


def _values(
    spark: SparkSession, zones: Zones, events: DataFrame, new: list[ModelContext], options: ModelOptions, scratch: Scratch
) -> DataFrame:
    """(session, page view, state columns), where an event that counts has a value.

    First the ids of events with a value; then all copies of these, as another
    copy may be the one that counts.
    """
    has = reduce(lambda a, b: a | b, [c.any_value() for c in new])
    valued = scratch.save(events.where(has).select("event_id", EVENT_DAY), "valued")
    ids = scratch.save(valued.where(F.col("event_id").isNotNull()).select("event_id").distinct(), "ids")
    count = ids.count()
    days = [*day_rows(valued.select(EVENT_DAY).distinct()), *day_rows(possible_days(spark.table(zones.event_index), ids, count))]
    near = events.where(partition_filter([EVENT_DAY], dict.fromkeys(days)))
    copies = keep_keys(near, ids, "event_id", count).unionByName(near.where(F.col("event_id").isNull() & has))
    rows = combine_activity(as_activity(dedup_events(copies), options)).select(*ACTIVITY_KEYS, *[c.state for c in new])
    return scratch.save(rows.where(reduce(lambda a, b: a | b, [F.col(c.state).isNotNull() for c in new])), "values")


def _replace(spark: SparkSession, table: str, keys: list[str], fresh: DataFrame, states: list[str]) -> None:
    """Set the state columns of all rows from ``fresh``, NULL without a row there."""
    stored = spark.table(table)
    stale = stored.where(reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in states]))
    due = stored.join(fresh.select(SESSION).distinct(), SESSION, "left_semi")
    days: list[Row] = stale.select(SESSION_DAY).unionByName(due.select(SESSION_DAY)).distinct().collect()
    if not days:
        return
    named = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys], *states)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = stored.where(partition_filter([SESSION_DAY], days)).drop(*states).join(named, same, "left")
    overwrite_partitions(rows, table, [SESSION_DAY])
