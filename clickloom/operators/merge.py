"""Keyed update of a partitioned table that rewrites only the partitions it matches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clickloom.session import Scratch
from clickloom.sources.tables import overwrite_partitions, partition_filter, table_partitions


def keyed_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A merge source from literal rows; values are parameters and never SQL text."""
    return spark.createDataFrame(rows, schema)


def check_unique(source: DataFrame, on: list[str]) -> DataFrame:
    """Source rows with a complete key; a repeated key is an error."""
    complete = source.dropna(subset=on)
    if not complete.groupBy(*on).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"merge source has more than one row for a value of {on}")
    return complete


def before_image(target: DataFrame, source: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Present values of ``columns`` in the rows that a merge on ``on`` would update."""
    return target.join(source.select(*on), on, "left_semi").select(*on, *columns)


def updated(
    target: DataFrame, source: DataFrame, on: list[str], changes: Mapping[str, Column]
) -> DataFrame:
    """All target rows, with ``changes`` made where the key matches.

    A change may name the source's columns as ``s.column``. The key has to be
    unique in the source.
    """
    t, s = target.alias("t"), source.withColumn("_matched", F.lit(True)).alias("s")
    same = [F.col(f"t.{c}") == F.col(f"s.{c}") for c in on]
    joined = t.join(s, same, "left")
    matched = F.col("s._matched").isNotNull()
    types = dict(target.dtypes)
    return joined.select(
        *[
            F.when(matched, changes[c].cast(types[c])).otherwise(F.col(f"t.{c}")).alias(c)
            if c in changes
            else F.col(f"t.{c}")
            for c in target.columns
        ]
    )


def matched_partitions(
    spark: SparkSession, table: str, source: DataFrame, on: list[str], partition_by: list[str]
) -> list[Row]:
    """Partitions of the table that hold a row to update.

    Two steps, both bounded by the table's own partitions: the catalog's
    partitions that the source names, then those of them where a key matches,
    which reads the key columns of the former only.
    """
    narrowing = [c for c in partition_by if c in source.columns]
    if not narrowing:
        raise ValueError(f"the source has none of the partition columns {partition_by}")
    named = source.select(*narrowing).distinct()
    existing = table_partitions(spark, table, partition_by).join(named, narrowing, "left_semi")
    candidates = existing.collect()
    if not candidates:
        return []
    matching = list(dict.fromkeys([*on, *narrowing]))
    keys = spark.table(table).where(partition_filter(partition_by, candidates))
    keys = keys.join(source.select(*matching), matching, "left_semi")
    return keys.select(*partition_by).distinct().collect()


def merge_update(
    spark: SparkSession,
    table: str,
    source: DataFrame,
    on: list[str],
    changes: Mapping[str, Column],
    partition_by: list[str],
    derive: Mapping[str, Column] | None = None,
) -> list[Row]:
    """``MERGE … WHEN MATCHED THEN UPDATE`` on a partitioned Parquet table.

    ``derive`` gives partition columns that the source lacks, e.g.
    ``{"event_day": day_of(col("collector_tstamp"))}``; use the expression the
    table was written with. Partition columns that the source neither has nor
    derives do not narrow the first step. Rows outside the matched partitions
    are neither read in full nor rewritten; without a match nothing is written.
    Returns the partitions that were rewritten.
    """
    changed_keys = set(changes) & {*partition_by, *on}
    if changed_keys:
        raise ValueError(f"cannot change key or partition columns: {sorted(changed_keys)}")
    with Scratch(spark) as scratch:
        # saved, so that all steps see the same source however it is computed
        source = check_unique(scratch.save(source.withColumns(dict(derive or {})), "source"), on)
        touched = matched_partitions(spark, table, source, on, partition_by)
        if touched:
            current = spark.table(table).where(partition_filter(partition_by, touched))
            overwrite_partitions(updated(current, source, on, changes), table, partition_by)
    return touched
