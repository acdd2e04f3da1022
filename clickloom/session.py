"""Session settings and the shared scratch area."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "clickloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local-mode session may go without: it gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder(context.applicationId)


@functools.cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"clickloom-{application_id}-")


class Scratch:
    """Intermediate tables of one run, in a schema of their own under the shared folder.

    Writing an intermediate result cuts its lineage: a lost executor costs the
    re-read of a table and never a recomputation with another outcome. As a
    context manager it drops everything at the end; without ``with`` the tables
    stay for as long as a lazy result may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.schema = f"scratch_{uuid.uuid4().hex}"
        spark.sql(f"CREATE SCHEMA {self.schema} LOCATION '{shared_dir(spark)}/{self.schema}'")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{self.schema}.{name}_{uuid.uuid4().hex[:8]}"
        df.write.format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        self.spark.sql(f"DROP SCHEMA IF EXISTS {self.schema} CASCADE")

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.drop()
