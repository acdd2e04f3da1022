"""Seed tables from CSV files that the user supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV seed with header; a malformed row stops the load."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def load_seed(spark: SparkSession, path: str, schema: str, table: str) -> DataFrame:
    read_seed(spark, path, schema).write.format("parquet").mode("overwrite").saveAsTable(table)
    return spark.table(table)
