"""Cloned batches on storage and their manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_DDL = """
    batch_index INT,
    name STRING,
    uri STRING,
    rows BIGINT,
    collector_tstamp_min TIMESTAMP_NTZ,
    collector_tstamp_max TIMESTAMP_NTZ,
    measured_tstamp_min TIMESTAMP_NTZ,
    measured_tstamp_max TIMESTAMP_NTZ,
    suffix STRING
"""


HEADER_DDL = """
    template_uri STRING,
    template_rows BIGINT,
    template_collector_tstamp_min TIMESTAMP_NTZ,
    template_collector_tstamp_max TIMESTAMP_NTZ,
    window_hours DOUBLE,
    batch_spacing_seconds DOUBLE
"""


# Fixed value: timestamps in a manifest; JSON would keep milliseconds only.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def write_batches(batches: DataFrame, path: str) -> None:
    """One folder per batch. Rows are not moved between tasks."""
    batches.write.option("compression", "snappy").mode("errorifexists").partitionBy("batch_index").parquet(path)


def read_batch(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.parquet(uri)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON row per batch, so a single small file."""
    manifest.coalesce(1).write.mode("overwrite").option("timestampNTZFormat", TIMESTAMP_FORMAT).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_DDL).option("timestampNTZFormat", TIMESTAMP_FORMAT).json(path)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The header of a manifest, written by ``write_manifest`` to a path of its own."""
    return spark.read.schema(HEADER_DDL).option("timestampNTZFormat", TIMESTAMP_FORMAT).json(path)


@dataclass(frozen=True)
class Batch:
    index: int
    name: str
    uri: str


def split_manifest(
    manifest: DataFrame, initial: int = 1, limit: int | None = None
) -> tuple[list[Batch], list[Batch]]:
    """The batches to load before the first build, and the ones after it, in order."""
    ordered = manifest.select("batch_index", "name", "uri").orderBy(F.col("batch_index"))
    rows = (ordered if limit is None else ordered.limit(limit)).collect()  # one row per batch
    batches = [Batch(*row) for row in rows]
    if not batches:
        raise ValueError("the manifest has no batches")
    if not 1 <= initial <= len(batches):
        raise ValueError("initial must be between 1 and the number of batches")
    return batches[:initial], batches[initial:]
