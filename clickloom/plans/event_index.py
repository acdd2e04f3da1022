"""On which days an event id may lie: Bloom filters of event ids, kept in the manifest zone.

A filter holds the ids of one day of one source (a batch, or the files of a
refresh), in blocks of 4 KB so that an id has all its bits in one block. Blocks are
numbered by the low bits of the id's hash and their number is a power of two, so a
look-up is a join on (number of blocks, block) and a test of a few bits. An id meets
one block of every filter, so many ids are tested block by block in numpy and only
those found leave the task. A filter never misses an id; at 32 bits an id it takes one in a million for another, which
costs reading two columns of a day in vain. Sources that are gone leave bits
behind, which costs no more than that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.filters import HASHED_KEYS
from clickloom.schema import EVENT_DAY
from clickloom.sources.tables import Zones, overwrite_partitions, table_partitions

SOURCE = "source"
# Fixed value: the bits of one of Spark's bitmaps.
BLOCK_BITS = 32_768
IDS_IN_BLOCK = 1_024
PROBES = 12

# So many tests of an id in a filter are left to a join with broadcast ids, more than that are done in numpy.
JOINED_TESTS = 500_000
# What a task holds at once: ids, and filters of 4 KB that they are tested in.
IDS_AT_ONCE = 524_288
FILTERS_AT_ONCE = 4_096


def id_hash(event_id: Column) -> Column:
    return F.xxhash64(event_id)


def _places(hashed: Column) -> list[Column]:
    """The bits of an id within its block."""
    second = F.xxhash64(hashed, F.lit("place"))
    first, step = second.bitwiseAND(F.lit(BLOCK_BITS - 1)), F.shiftright(second, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).bitwiseOR(F.lit(1))
    return [(first + i * step).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("long")
    return F.getbit(value, place.bitwiseAND(F.lit(7)).cast("int")) == 1


def filters_of(ids: DataFrame) -> DataFrame:
    """(event_day, blocks, block, bitmap, source) for (event_id, event_day, source) rows; rows without an id are in none."""
    hashed = ids.where("event_id IS NOT NULL").select(id_hash(F.col("event_id")).alias("hash"), EVENT_DAY, SOURCE)
    sizes = hashed.groupBy(F.col(EVENT_DAY).alias("_day"), F.col(SOURCE).alias("_source")).agg(F.count("*").alias("rows"))
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("rows") / IDS_IN_BLOCK, F.lit(1.0))))).cast("long")
    same = F.col(EVENT_DAY).eqNullSafe(F.col("_day")) & (F.col(SOURCE) == F.col("_source"))
    sized = hashed.join(sizes.select("_day", "_source", blocks.alias("blocks")), same).drop("_day", "_source")
    keys = [EVENT_DAY, SOURCE, "blocks", "block"]
    dealt = sized.withColumn("block", F.col("hash").bitwiseAND(F.col("blocks") - 1)).repartition(*keys)
    # one bitmap a probe, then their union: sorts every id once and not once a probe
    names = [f"bits_{i}" for i in range(PROBES)]
    made = dealt.select(*keys, *[p.alias(n) for n, p in zip(names, _places(F.col("hash")))])
    made = made.groupBy(*keys).agg(*[F.bitmap_construct_agg(n).alias(n) for n in names])
    return made.select(*keys, F.explode(F.array(*names)).alias("bits")).groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bitmap"))


def create_index(spark: SparkSession, zones: Zones) -> None:
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {zones.event_index} ({EVENT_DAY} DATE, blocks BIGINT, block BIGINT, bitmap BINARY, "
        f"{SOURCE} STRING) USING parquet PARTITIONED BY ({SOURCE})"
    )


def indexed_sources(spark: SparkSession, zones: Zones) -> set[str]:
    return {r[SOURCE] for r in table_partitions(spark, zones.event_index, [SOURCE]).collect()}


def index_sources(spark: SparkSession, zones: Zones, ids: DataFrame) -> None:
    """Put the ids (event_id, event_day, source) in place of those that their sources had."""
    create_index(spark, zones)
    overwrite_partitions(filters_of(ids), zones.event_index, [SOURCE])


def possible_places(index: DataFrame, ids: DataFrame, at_most: int) -> DataFrame:
    """(hash, event_day, source) of the filters that have the ids in ``event_id``, which are ``at_most`` many.

    Filters are read once. For a few ids their hashes are broadcast and no filter is
    shuffled; for more, ids and filters are dealt by block.
    """
    rows = {r["blocks"]: r["count"] for r in index.groupBy("blocks").count().collect()}  # one per power of two
    hashed = ids.where("event_id IS NOT NULL").select(id_hash(F.col("event_id")).alias("hash")).distinct()
    filters = {blocks: -(-n // blocks) for blocks, n in rows.items()}
    few = at_most * sum(filters.values()) <= max(JOINED_TESTS, sum(rows.values()))
    if not few or at_most * len(rows) > HASHED_KEYS:
        return _tested_by_block(index, hashed, at_most, filters)
    probes = F.broadcast(_dealt(hashed, list(rows)))
    met = index.join(probes, ["blocks", "block"])
    held = reduce(lambda a, b: a & b, [_is_set(F.col("bitmap"), p) for p in _places(F.col("hash"))])
    return met.where(held).select("hash", EVENT_DAY, SOURCE)


def _dealt(hashed: DataFrame, sizes: list[int]) -> DataFrame:
    """The hashes with their block, once for every size of filter."""
    blocks = F.explode(F.array(*[F.lit(s).cast("long") for s in sizes]).cast("array<bigint>")).alias("blocks")
    return hashed.select("hash", blocks).withColumn("block", F.col("hash").bitwiseAND(F.col("blocks") - 1))


def _tested_by_block(index: DataFrame, hashed: DataFrame, at_most: int, filters: dict[int, int]) -> DataFrame:
    """Ids and filters meet by (number of blocks, block). Where too many would meet, as in filters of
    one block, ids are cut into pieces and so are filters, and each of the former meets each of the latter."""
    ids_cut = {s: -(-at_most // (s * IDS_AT_ONCE)) or 1 for s in filters}
    filters_cut = {s: -(-n // FILTERS_AT_ONCE) for s, n in filters.items()}

    def cuts(of: dict[int, int]) -> Column:
        return reduce(lambda a, s: F.when(F.col("blocks") == s, F.lit(of[s])).otherwise(a), of, F.lit(1)).cast("long")

    def every(of: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), cuts(of) - 1))

    places = F.xxhash64("hash", F.lit("place")).alias("places")
    ids = _dealt(hashed, list(filters)).select("*", places, F.pmod(F.shiftright("hash", 40), cuts(ids_cut)).alias("piece"))
    ids = ids.withColumn("part", every(filters_cut))
    cut = index.withColumn("part", F.pmod(F.xxhash64(EVENT_DAY, SOURCE), cuts(filters_cut))).withColumn("piece", every(ids_cut))
    keys = ["blocks", "block", "piece", "part"]
    met = ids.groupBy(*keys).cogroup(cut.select(*keys, EVENT_DAY, SOURCE, "bitmap").groupBy(*keys))
    return met.applyInArrow(_tester(), f"hash BIGINT, {EVENT_DAY} DATE, {SOURCE} STRING")


def _tester() -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Arrow function; built on demand so that workers need not import this package."""

    def members(bitmap: pa.Buffer, first: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Positions of the ids all of whose bits are set."""
        bits = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little").view(bool)
        left = np.flatnonzero(bits[first])
        for probe in range(1, PROBES):
            left = left[bits[(first[left] + probe * step[left]) & (BLOCK_BITS - 1)]]
        return left

    def tested(ids: pa.Table, filters: pa.Table) -> pa.Table:
        """The ids of a block that are in its filters."""
        hashes = ids["hash"].to_numpy()
        places = ids["places"].to_numpy()
        first, step = places & (BLOCK_BITS - 1), places >> 15 & (BLOCK_BITS - 1) | 1
        # without ids of this block its filters have nothing to test
        found = [members(bitmap.as_buffer(), first, step) for bitmap in filters["bitmap"]] if len(hashes) else []
        at = np.concatenate([np.empty(0, dtype="int64"), *found])
        of = np.repeat(np.arange(len(found)), [len(f) for f in found])
        held = filters.select([EVENT_DAY, SOURCE]).take(pa.array(of, pa.int64()))
        return pa.table({"hash": pa.array(hashes[at], pa.int64()), EVENT_DAY: held[EVENT_DAY], SOURCE: held[SOURCE]})

    return tested


def possible_days(index: DataFrame, ids: DataFrame, at_most: int) -> DataFrame:
    """(event_day): the days on which one of the ids may lie."""
    return possible_places(index, ids, at_most).select(EVENT_DAY).distinct()


def day_rows(days: DataFrame) -> list[Row]:
    """Days on the driver, for a literal partition filter; the unknown day is always among them."""
    return [Row(**{EVENT_DAY: None}), *[r for r in days.collect() if r[EVENT_DAY] is not None]]
