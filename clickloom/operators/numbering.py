"""Row numbers within a key, also where one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import Scratch

HOT_ROWS = 1_000_000


def number_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    name: str,
    scratch: Scratch,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row_number()`` over ``key`` by ``order`` as bigint column ``name``.

    ``order`` must be unique within a key. ``df`` is read more than once, so
    pass a stored table. A window puts a whole key into one task; keys of more
    than ``hot_rows`` rows are numbered in range-partitioned pieces instead.
    """
    window = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    if df.count() <= hot_rows:  # answered from the stored table's footers
        return df.withColumn(name, window)
    hot = scratch.save(
        df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(key), "hot_keys"
    )
    if hot.isEmpty():
        return df.withColumn(name, window)
    # At most count(df) / hot_rows keys are hot, which is what makes them fit a broadcast.
    hot_keys = F.broadcast(hot)
    same_key = df[key].eqNullSafe(hot[key])
    cold = df.join(hot_keys, same_key, "left_anti").withColumn(name, window)
    pieces = _number_in_pieces(df.join(hot_keys, same_key, "left_semi"), key, order, name, scratch)
    return cold.unionByName(pieces)


def _number_in_pieces(df: DataFrame, key: str, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Global sort, then position in the piece plus the rows of the key's earlier pieces."""
    placed = scratch.save(
        df.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        # the upper bits number the sorted partitions, the lower 33 the rows in them
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_piece", F.shiftright("_place", 33))
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and piece it reaches into: hot keys plus sort partitions at most.
    pieces = (
        placed.groupBy(key, "_piece")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .select(F.col(key).alias("_key"), F.col("_piece").alias("_at"), "_first", "_before")
    )
    return (
        placed.join(
            F.broadcast(pieces), placed[key].eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_at"))
        )
        .withColumn(name, F.col("_before") + F.col("_place") - F.col("_first") + 1)
        .drop("_place", "_piece", "_key", "_at", "_first", "_before")
    )
