"""Intermediate results in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import shared_dir


#: Whether Spark deletes the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: what a lost executor costs is reading a file again. The
    shuffle files of the query go with its end; else they would stay until the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm_{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._saved_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables as ``saved`` returned them, which nothing may read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Python workers of this session get at most ``BATCH_BYTES`` of rows at a time.

    Spark's own limit, 64 MB, lets a few long texts fill an executor, which holds
    a batch on both sides for every core. A lower limit of the session stays.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(setting).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns called like ``names`` under other names, and its own columns to select later."""
    hidden = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(hidden), [F.col(hidden.get(c, c)).alias(c) for c in docs.columns]


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
