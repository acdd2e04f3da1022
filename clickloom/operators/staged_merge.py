"""A keyed update in two phases, with a log from which it is finished or taken back.

The new partitions are written aside, in a folder of the table that no scan sees.
Then one append to the log names them with the folders that the partitions have now;
from here on the merge is decided. Each partition is switched by giving it its new
location, which moves no data. A merge that ended before its log entry left the table
as it was; one that ended between two switches is finished by ``settle_merges``. The
old folders stay, so ``undo_merge`` switches back to them, in the same two phases.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.merge import check_unique, matched_partitions, updated
from clickloom.session import Scratch
from clickloom.sources.tables import bounded_sort, partition_filter, partition_spec, spread

LOG = "merge_id STRING, partition STRING, old STRING, new STRING, step STRING, at TIMESTAMP"
STAGED, DONE, UNDOING, UNDONE = "staged", "done", "undoing", "undone"


def staged_merge(
    spark: SparkSession,
    table: str,
    source: DataFrame,
    on: list[str],
    changes: Mapping[str, Column],
    partition_by: list[str],
    log: str,
    derive: Mapping[str, Column] | None = None,
) -> str | None:
    """``merge_update`` in two phases; returns the id of the merge, None if no row matched.

    Takes what ``merge_update`` takes, and the name of the ``log`` table. The driver
    sees the partitions that are touched and their folders.
    """
    changed_keys = set(changes) & {*partition_by, *on}
    if changed_keys:
        raise ValueError(f"cannot change key or partition columns: {sorted(changed_keys)}")
    settle_merges(spark, table, log)
    with Scratch(spark) as scratch:
        source = check_unique(scratch.save(source.withColumns(dict(derive or {})), "source"), on)
        touched = matched_partitions(spark, table, source, on, partition_by)
        if not touched:
            return None
        merge_id = uuid.uuid4().hex
        aside = f"{_described(spark, table)}/_merge_{merge_id}"
        current = spark.table(table).where(partition_filter(partition_by, touched))
        rows = updated(current, source, on, changes)
        with bounded_sort(rows):
            spread(rows, partition_by).write.option("compression", "zstd").partitionBy(*partition_by).parquet(aside)
    entries = [
        (merge_id, json.dumps(partition_spec(r, partition_by)), _described(spark, table, partition_spec(r, partition_by)), new, STAGED)
        for r, new in _folders(spark, aside, partition_by, spark.table(table))
    ]
    _note(spark, log, entries)
    _switch(spark, table, log, merge_id, STAGED)
    return merge_id


def undo_merge(spark: SparkSession, table: str, merge_id: str, log: str) -> int:
    """Give the partitions of a merge their folders from before it; returns their number.

    An error if one of them has been switched again since, as that would be lost.
    """
    settle_merges(spark, table, log)
    steps = _steps(spark, log)
    if steps.get(merge_id) != DONE:
        raise ValueError(f"merge {merge_id} is {steps.get(merge_id, 'unknown')}")
    entries = spark.table(log).where((F.col("merge_id") == merge_id) & (F.col("step") == STAGED)).collect()
    for entry in entries:
        if _path(_described(spark, table, json.loads(entry["partition"]))) != _path(entry["new"]):
            raise ValueError(f"partition {entry['partition']} has another folder since the merge")
    _note(spark, log, [(merge_id, e["partition"], e["new"], e["old"], UNDOING) for e in entries])
    return _switch(spark, table, log, merge_id, UNDOING)


def settle_merges(spark: SparkSession, table: str, log: str) -> list[str]:
    """Finish what was logged and not switched to the end; returns the ids of these merges."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {log} ({LOG}) USING parquet")
    open_ = {m: s for m, s in _steps(spark, log).items() if s in (STAGED, UNDOING)}
    for merge_id, step in open_.items():
        _switch(spark, table, log, merge_id, step)
    return sorted(open_)


def _steps(spark: SparkSession, log: str) -> dict[str, str]:
    """The last step of each merge."""
    order = F.array_position(F.lit([STAGED, DONE, UNDOING, UNDONE]), F.col("step"))
    return {r["merge_id"]: r["step"] for r in spark.table(log).groupBy("merge_id").agg(F.max_by("step", order).alias("step")).collect()}


def _switch(spark: SparkSession, table: str, log: str, merge_id: str, step: str) -> int:
    entries = spark.table(log).where((F.col("merge_id") == merge_id) & (F.col("step") == step)).orderBy("partition").collect()
    for entry in entries:
        _point(spark, table, json.loads(entry["partition"]), entry["new"])
    spark.catalog.refreshTable(table)
    _note(spark, log, [(merge_id, None, None, None, DONE if step == STAGED else UNDONE)])
    return len(entries)


def _point(spark: SparkSession, table: str, spec: str, location: str) -> None:
    quoted = location.replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION '{quoted}'")


def _note(spark: SparkSession, log: str, entries: list[tuple]) -> None:
    rows = spark.createDataFrame(entries, LOG.removesuffix(", at TIMESTAMP")).withColumn("at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").insertInto(log)


def _folders(spark: SparkSession, aside: str, partition_by: list[str], table: DataFrame) -> list[tuple[Row, str]]:
    """(partition values, folder) of what was written; file paths come as URIs."""
    written = spark.read.schema(table.schema).parquet(aside)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("_folder")
    return [(r, unquote(r["_folder"])) for r in written.select(*partition_by, folder).distinct().collect()]


def _described(spark: SparkSession, table: str, spec: str | None = None) -> str:
    """Where the table, or one of its partitions, lies."""
    of = f" PARTITION ({spec})" if spec else ""
    return spark.sql(f"DESCRIBE EXTENDED {table}{of}").where("col_name = 'Location'").first()["data_type"]


def _path(location: str) -> str:
    """A location without its scheme, which may be written with one slash or three."""
    return re.sub(r"^\w+:/+", "/", location).rstrip("/")
