"""Which files and partitions a table has, and which of them a write touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File status and content codes of an inventory.
EXISTING, ADDED, DELETED = 0, 1, 2
DATA, POSITION_DELETE, EQUALITY_DELETE = 0, 1, 2


def file_inventory(table: DataFrame, partition_by: list[str]) -> DataFrame:
    """One row per data file of a table as read now.

    Only partition values and file names are read; row counts come from the
    Parquet footers.
    """
    return (
        table.groupBy(
            F.struct(*partition_by).alias("partition"), F.col("_metadata.file_path").alias("path")
        )
        .agg(F.count("*").alias("record_count"))
        .select("partition", "path", "record_count", F.lit(ADDED).alias("status"), F.lit(DATA).alias("content"))
    )


def live_files(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("status") != DELETED)


def data_files(inventory: DataFrame) -> DataFrame:
    return live_files(inventory).where(F.col("content") == DATA)


def partition_stats(inventory: DataFrame) -> DataFrame:
    """Rows and files of every partition, live data files only."""
    return data_files(inventory).groupBy("partition").agg(
        F.sum("record_count").alias("rows"), F.count("*").alias("files")
    )


def smallest_partition(inventory: DataFrame) -> DataFrame:
    """The partition of fewest rows; the lowest partition value among equals."""
    return partition_stats(inventory).orderBy("rows", "partition").limit(1)


def sample_partition(table: DataFrame, condition: Column, rows: int, order: str = "event_id") -> DataFrame:
    """``rows`` rows of one partition, the same ones each time."""
    return table.where(condition).orderBy(order).limit(rows)


def touched_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Live files in one inventory only, with ``change`` added or removed."""
    old, new = live_files(before), live_files(after)
    added = new.join(old.select("path"), "path", "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new.select("path"), "path", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def audit_partitions(before: DataFrame, after: DataFrame, target: Column) -> DataFrame:
    """One row of counts and the verdict.

    ``target`` is the condition that a file's ``partition`` is one the write
    may touch. The audit passes if files were touched, all of them in there.
    """
    inside = F.coalesce(target, F.lit(False))
    counts = touched_files(before, after).agg(
        F.count_if(F.col("change") == "added").alias("added_files"),
        F.count_if(F.col("change") == "removed").alias("removed_files"),
        F.count_if(inside).alias("touched_in_target"),
        F.count_if(~inside).alias("touched_outside_target"),
    )
    return counts.withColumn(
        "pass", (F.col("touched_outside_target") == 0) & (F.col("touched_in_target") > 0)
    )


def audit_details(before: DataFrame, after: DataFrame, target: Column) -> dict[str, DataFrame]:
    """File lists for the report, by path; all of them, whoever prints them may take less."""
    files = touched_files(before, after)
    outside = ~F.coalesce(target, F.lit(False))

    def listed(condition: Column, *columns: str) -> DataFrame:
        return files.where(condition).orderBy("path").select(*columns)

    detail = ("partition", "path", "record_count", "content")
    return {
        "added_detail": listed(F.col("change") == "added", *detail),
        "removed_detail": listed(F.col("change") == "removed", *detail),
        "outside_target": listed(outside, "partition", "path", "content"),
    }
