"""Order-independent fingerprints of rows, to prove what a write has left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, partition_by: list[str]) -> DataFrame:
    """Per partition the number of rows and the sums of two hashes over all columns.

    Equal multisets of rows have equal fingerprints, whatever their order and
    files; a changed cell, or a NULL that moves to another column, changes both sums.
    """
    columns = sorted(rows.columns)
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in columns]
    hashes = [F.xxhash64(F.lit(seed), *marked).cast("decimal(20,0)") for seed in (1, 2)]
    return rows.groupBy(*partition_by).agg(F.count("*").alias("rows"), *[F.sum(h).alias(f"sum_{i}") for i, h in enumerate(hashes, 1)])


def untouched(rows: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """The rows that a merge of ``source`` on these keys has to leave as they are."""
    return rows.join(source.select(*on).dropna().distinct(), on, "left_anti")


def compare_fingerprints(before: DataFrame, after: DataFrame, partition_by: list[str]) -> DataFrame:
    """One row per partition on either side: its rows before and after, and whether they are the same."""
    names = ["rows", "sum_1", "sum_2"]
    old, new = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in [*partition_by, *names]]) for df, side in ((before, "old"), (after, "new")))
    keys = [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in partition_by]
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}"))
    count = lambda side: F.coalesce(F.col(f"{side}_rows"), F.lit(0)).alias(f"rows_{side}")
    values = [F.coalesce(f"old_{c}", f"new_{c}").alias(c) for c in partition_by]
    return old.join(new, keys, "full").select(*values, count("old"), count("new"), same.alias("same"))
