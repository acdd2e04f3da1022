"""Checks on a loaded table, all of them in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule: how many rows were tested and how many broke it.

    A rule is a condition that each row has to meet; NULL counts as broken.
    """
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()],
    )
    entries = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(name).alias("broken")) for name in rules]
    )
    return counts.select(F.inline(entries), F.col("_rows").alias("rows")).select(
        "rule", "rows", "broken", ((F.col("broken") == 0) & (F.col("rows") > 0)).alias("passed")
    )


def verify_count(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of ``df`` against rows of ``expected``, e.g. target against filtered source."""
    sides = df.select(F.lit(1).alias("rows"), F.lit(0).alias("expected_rows")).unionByName(
        expected.select(F.lit(0).alias("rows"), F.lit(1).alias("expected_rows"))
    )
    totals = sides.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sides.columns])
    return totals.withColumn("passed", F.col("rows") == F.col("expected_rows"))


def source_metrics(events: DataFrame, tstamp: str = "collector_tstamp") -> DataFrame:
    """Row count and event-time bounds."""
    return events.agg(
        F.count("*").alias("row_count"),
        F.min(tstamp).alias(f"min_{tstamp}"),
        F.max(tstamp).alias(f"max_{tstamp}"),
    )
