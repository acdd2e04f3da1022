"""Left join against a seed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(df: DataFrame, seed: DataFrame, key: str | list[str]) -> DataFrame:
    """Add the seed's columns by ``key``; a duplicate seed key is an error.

    There is no broadcast hint: Spark broadcasts the seed where its measured
    size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
    shuffles, splitting skewed keys adaptively.
    """
    keys = [key] if isinstance(key, str) else key
    repeated = seed.groupBy(*keys).count().where(F.col("count") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"seed has more than one row for a value of {keys}")
    return df.join(seed, keys, "left")
