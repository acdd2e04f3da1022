"""Filters on partitions and keys."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.schema import EVENT_DAY

SHORT_LIST = 1_000

# Between these numbers of keys a broadcast of their hashes is worth while and
# has a known size: the upper one stands for about 150 MB on an executor.
FEW_KEYS = 100_000
HASHED_KEYS = 4_000_000


def in_partition(day: date, event_name: str) -> Column:
    """One day and event name, as a condition on the partition columns."""
    return (F.col(EVENT_DAY) == F.lit(day)) & (F.col("event_name") == event_name)


def on_day(tstamp: str, day: date, day_from: str) -> Column:
    """``CAST(tstamp AS DATE) = day``; prunes files where ``tstamp`` made the partitions."""
    same_day = F.to_date(tstamp) == F.lit(day)
    return same_day & (F.col(EVENT_DAY) == F.lit(day)) if tstamp == day_from else same_day


def in_list(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``values``: a literal list if short, else a semi join.

    Values are taken in the column's type however many there are; one that has
    no form in it, and NULL, matches nothing.
    """
    data_type = dict(df.dtypes)[column]
    if isinstance(values, DataFrame):
        typed = values.toDF(column).select(F.col(column).try_cast(data_type).alias(column))
        return df.join(typed, column, "left_semi")
    known = [v for v in values if v is not None]
    if len(known) <= SHORT_LIST:
        return df.where(F.col(column).isin([F.lit(v).try_cast(data_type) for v in known]))
    by_type: dict[type, list] = {}
    for value in known:
        by_type.setdefault(type(value), []).append((value,))
    listed = [df.sparkSession.createDataFrame(v, [column]).select(F.col(column).try_cast(data_type).alias(column)) for v in by_type.values()]
    return df.join(reduce(DataFrame.unionByName, listed), column, "left_semi")


def keep_keys(
    df: DataFrame,
    keys: DataFrame,
    column: str,
    at_most: int,
    few: int = FEW_KEYS,
    hashed: int = HASHED_KEYS,
) -> DataFrame:
    """Rows of a large table whose ``column`` is among ``keys``, not NULL and ``at_most`` many.

    Few keys Spark broadcasts by itself. A middling number would make it
    shuffle all of ``df``; here 64-bit hashes of the keys are broadcast first,
    which leaves little more than the wanted rows for the exact join. More keys
    than that are left to a shuffled join.
    """
    if few < at_most <= hashed:
        hashes = keys.select(F.xxhash64(column).alias("_hash"))
        df = df.withColumn("_hash", F.xxhash64(column)).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    return df.join(keys, column, "left_semi")
