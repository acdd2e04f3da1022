"""Building the derived tables from all events."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.times import day_of
from clickloom.plans.models import (
    HAS_PAGE_VIEW,
    PAGE_VIEW_COLUMNS,
    SESSION,
    SESSION_COLUMNS,
    ModelOptions,
    activity_of,
    index_page_views,
    session_rollup,
    sessions,
    users,
)
from clickloom.schema import BATCH_ID
from clickloom.session import Scratch
from clickloom.sources.tables import Zones, table_partitions, write_partitioned

SESSION_DAY = "session_day"
LAST_SEEN_DAY = "last_seen_day"


def with_session_day(state: DataFrame) -> DataFrame:
    """Both state tables are partitioned by the day a session starts."""
    return state.withColumn(SESSION_DAY, day_of(F.col("start_tstamp")))


def with_last_seen_day(user_rows: DataFrame) -> DataFrame:
    """Users are partitioned by the day they were last seen, so that a refresh
    finds the users of recent events in recent partitions."""
    return user_rows.withColumn(LAST_SEEN_DAY, day_of(F.col("last_seen")))


def place_activity(indexed: DataFrame, state: DataFrame) -> DataFrame:
    """Activity rows with the day of their session."""
    return indexed.join(state.select(SESSION, SESSION_DAY), SESSION)


def build(spark: SparkSession, zones: Zones, options: ModelOptions = ModelOptions()) -> None:
    """Rebuild all derived tables. Wide rows of events are shuffled once, by event id.

    The batch log goes first and comes back last: where it exists, the other
    tables are complete.
    """
    events = spark.table(zones.events)
    with Scratch(spark) as scratch:
        batches = scratch.save(loaded_batches(spark, zones), "batches")
        activity = scratch.save(activity_of(events, options), "activity")
        spark.sql(f"DROP TABLE IF EXISTS {zones.batches}")
        write_partitioned(with_session_day(session_rollup(activity)), zones.session_state, [SESSION_DAY])
        state = spark.table(zones.session_state)
        write_partitioned(with_last_seen_day(users(sessions(state))), zones.users, [LAST_SEEN_DAY])
        indexed = index_page_views(activity, scratch, options)
        write_partitioned(place_activity(indexed, state), zones.page_activity, [SESSION_DAY])
        publish(spark, zones, options)
        note_contexts(spark, zones, options)
        log_batches(zones, batches)
        spark.sql(f"DROP TABLE IF EXISTS {zones.replaced}")


def is_built(spark: SparkSession, zones: Zones) -> bool:
    return spark.catalog.tableExists(zones.batches)


def loaded_batches(spark: SparkSession, zones: Zones) -> DataFrame:
    """Ids of the batches in the events table, none if it keeps no batches apart."""
    if BATCH_ID not in spark.table(zones.events).columns:
        return spark.createDataFrame([], f"{BATCH_ID} STRING")
    return table_partitions(spark, zones.events, [BATCH_ID]).distinct()


def log_batches(zones: Zones, batch_ids: DataFrame) -> None:
    """Note batches whose events the derived tables hold, or may hold from now on."""
    rows = batch_ids.withColumn("started_at", F.current_timestamp())
    rows.coalesce(1).write.format("parquet").mode("append").saveAsTable(zones.batches)


def publish(spark: SparkSession, zones: Zones, options: ModelOptions = ModelOptions()) -> None:
    """Page views and sessions are views on the state tables, which hold each
    row once; filters and column pruning reach the files through them."""
    spark.sql(
        f"CREATE OR REPLACE VIEW {zones.page_views} AS "
        f"SELECT {', '.join(PAGE_VIEW_COLUMNS + options.context_columns())} FROM {zones.page_activity} WHERE {HAS_PAGE_VIEW}"
    )
    spark.sql(
        f"CREATE OR REPLACE VIEW {zones.sessions} AS "
        f"SELECT {', '.join(SESSION_COLUMNS + options.context_columns())} FROM {zones.session_state}"
    )


#: The property of the session state that names the contexts its tables hold.
CONTEXTS_NOTED = "contexts"


def context_note(options: ModelOptions) -> str:
    """State columns that are kept up to date, and a digest of what the views show."""
    if not options.contexts:
        return ""
    shown = hashlib.sha256(repr(options.context_columns()).encode()).hexdigest()[:12]
    return ",".join([c.state for c in options.active_contexts]) + ";" + shown


def note_contexts(spark: SparkSession, zones: Zones, options: ModelOptions) -> None:
    spark.sql(f"ALTER TABLE {zones.session_state} SET TBLPROPERTIES ('{CONTEXTS_NOTED}' = '{context_note(options)}')")


def noted_contexts(spark: SparkSession, zones: Zones) -> str:
    found = spark.sql(f"SHOW TBLPROPERTIES {zones.session_state}").where(F.col("key") == CONTEXTS_NOTED).first()
    return found["value"] if found else ""
