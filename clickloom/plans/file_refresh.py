"""Refresh of the derived tables from an events table without batch ids, by its files.

The manifest zone keeps which files the derived tables hold, and of each file its
event and session ids, since a file that is gone can no longer be asked. A refresh
compares the files of the table with those: only new files are read, and sessions
of files that are gone are recomputed, with all copies of their events. A file that
was rewritten, in place too, counts as gone and new. So rows may reach the table in
any way: appended, rewritten by a merge, or deleted with their partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.filters import in_list
from clickloom.plans.build import build, is_built
from clickloom.plans.context_state import align_contexts
from clickloom.plans.event_index import SOURCE, index_sources
from clickloom.plans.models import SESSION, ModelOptions, model_events
from clickloom.plans.refresh import Delta, refresh_delta
from clickloom.schema import EVENT_DAY
from clickloom.session import Scratch
from clickloom.sources.tables import Zones, partition_filter

FILE = ["path", "size", "modified"]
RUN = "run"
PATH = "_path"


def table_files(table: DataFrame) -> DataFrame:
    """(path, size, modified, event_day): the files of an events table as it is now; no column is read."""
    return _with_file(table).select(*FILE, EVENT_DAY).distinct()


def held_files(spark: SparkSession, zones: Zones) -> DataFrame:
    """(path, size, modified, run): files that the derived tables hold, with the run that added them."""
    ended = spark.table(zones.file_runs).where("held").select(RUN)
    log = spark.table(zones.files).join(ended, RUN, "left_semi")
    held = log.groupBy(*FILE).agg(F.sum("change").alias("times"), F.max_by(RUN, "change").alias(RUN))
    return held.where("times > 0").drop("times")


def refresh_files(spark: SparkSession, zones: Zones, options: ModelOptions = ModelOptions()) -> dict[str, int]:
    """Bring the derived tables up to date with the files of the events table.

    The outcome equals that of ``build``. Returns the numbers of ``added`` and
    ``removed`` files. The first call builds. The files of a run are noted before
    and the end of the run after the derived tables are changed, so a run that was
    interrupted is found by the next one, which recomputes what it had begun.
    The driver sees the paths of new and removed files, not of all.
    """
    _create(spark, zones)
    run = uuid.uuid4().hex
    events = spark.table(zones.events)
    with Scratch(spark) as scratch:
        now = scratch.save(table_files(events), "now")
        if spark.table(zones.file_runs).isEmpty() or not is_built(spark, zones):
            spark.sql(f"DROP TABLE {zones.files}")
            spark.sql(f"DROP TABLE {zones.file_runs}")
            spark.sql(f"DROP TABLE {zones.file_events}")
            spark.sql(f"DROP TABLE IF EXISTS {zones.event_index}")
            _create(spark, zones)
            build(spark, zones, options)
            _note(zones, now, run, 1)
            _note_events(spark, zones, _with_file(events), run)
            _end(spark, zones, run)
            return {"added": now.count(), "removed": 0}
        held = scratch.save(held_files(spark, zones), "held")
        new = scratch.save(now.join(held, FILE, "left_anti"), "new")
        old = scratch.save(held.join(now, FILE, "left_anti"), "old")
        added, removed = new.count(), old.count()
        begun = spark.table(zones.files).join(spark.table(zones.file_runs), RUN, "left_anti")
        interrupted = not begun.isEmpty()
        others = model_events(_without(events, new), options)
        align_contexts(spark, zones, others, options)
        if not added and not removed and not interrupted:
            return {"added": 0, "removed": 0}
        gone = _events_of(spark, zones, old)
        if interrupted:  # files of runs that have not ended may have come and gone
            gone = gone.unionByName(_events_of(spark, zones, begun.select(*FILE, RUN)))
        gone = scratch.save(gone.distinct(), "gone")
        _note(zones, new, run, 1)
        _note(zones, old, run, -1)
        rows = _rows_of(events, new)
        _note_events(spark, zones, rows, run)
        batch = scratch.save(model_events(rows, options), "batch")
        refresh_delta(spark, zones, Delta(model_events(events, options), batch, others, gone, interrupted), options, scratch)
        _end(spark, zones, run)
    return {"added": added, "removed": removed}


def _with_file(events: DataFrame) -> DataFrame:
    """Events with the path, size and time of their file."""
    meta = (("file_path", "path"), ("file_size", "size"), ("file_modification_time", "modified"))
    return events.select("*", *[F.col(f"_metadata.{c}").alias(n) for c, n in meta])


def _rows_of(events: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of these files: their days and paths prune the scan."""
    named = files.select("path", EVENT_DAY).collect()
    days = {r[EVENT_DAY]: r for r in named}.values()
    return in_list(_with_file(events).where(partition_filter([EVENT_DAY], days)), "path", [r["path"] for r in named])


def _without(events: DataFrame, files: DataFrame) -> DataFrame:
    return _with_file(events).join(files.select("path"), "path", "left_anti")


def _create(spark: SparkSession, zones: Zones) -> None:
    file = "path STRING, size BIGINT, modified TIMESTAMP"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {zones.files} ({file}, {RUN} STRING, change INT) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {zones.file_runs} ({RUN} STRING, held BOOLEAN) USING parquet")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {zones.file_events} ({file}, event_id STRING, {SESSION} STRING, {RUN} STRING) "
        f"USING parquet PARTITIONED BY ({RUN})"
    )


def _note(zones: Zones, files: DataFrame, run: str, change: int) -> None:
    noted = files.select(*FILE, F.lit(run).alias(RUN), F.lit(change).alias("change"))
    noted.write.mode("append").insertInto(zones.files)


def _note_events(spark: SparkSession, zones: Zones, rows: DataFrame, run: str) -> None:
    """Event and session ids of each new file, and the index of the event ids."""
    ids = rows.select(*FILE, "event_id", SESSION).distinct().withColumn(RUN, F.lit(run))
    ids.write.mode("append").insertInto(zones.file_events)
    index_sources(spark, zones, rows.select("event_id", EVENT_DAY, F.lit(f"files_{run}").alias(SOURCE)))


def _events_of(spark: SparkSession, zones: Zones, files: DataFrame) -> DataFrame:
    """(event_id, session) that files held; only the runs that added them are read."""
    runs = [r[RUN] for r in files.select(RUN).distinct().collect()]
    noted = spark.table(zones.file_events).where(F.col(RUN).isin(runs))
    return noted.join(files.select(*FILE), FILE, "left_semi").select("event_id", SESSION)


def _end(spark: SparkSession, zones: Zones, run: str) -> None:
    """Marks the run as ended; what earlier runs had begun is part of it."""
    begun = spark.table(zones.files).where(F.col(RUN) != run).select(RUN).distinct().join(spark.table(zones.file_runs), RUN, "left_anti")
    rows = begun.withColumn("held", F.lit(False)).unionByName(spark.createDataFrame([(run, True)], f"{RUN} STRING, held BOOLEAN"))
    rows.coalesce(1).write.mode("append").insertInto(zones.file_runs)
