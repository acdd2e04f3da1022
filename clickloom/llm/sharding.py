"""Contiguous shards of least possible size."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.storage import saved

KEY_BITS = 60


@dataclass(frozen=True)
class ShardOptions:
    """``first_bits``: the groups are first seen as 2**first_bits stretches; ``more_bits``: what a
    stretch is divided into where a cut may lie; ``margin``: stretches on each side that are divided
    with it. They bound what the driver holds and change no cut. ``rows_per_part``: documents that
    one task numbers."""

    shards: int = 16
    first_bits: int = 12
    more_bits: int = 6
    margin: int = 4
    rows_per_part: int = 20_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def assign_shards(docs: DataFrame, options: ShardOptions = ShardOptions(), id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``.

    The atomic groups are equal texts, in the order of a 60-bit hash of the text
    (texts that share a hash are one group; null texts are a group). Shards are
    stretches of that order. The smallest capacity for which they hold everything
    is found by binary search, each capacity being checked greedily; then the row
    is cut so that no shard exceeds it, each as near as possible to its share of
    what is left. ``slot`` numbers the rows of a shard without gaps from 0, by
    hash and id. With fewer groups than shards, shards stay empty. Columns
    called like a new one are replaced.
    """
    text = F.col("text").cast("string")
    key = F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)
    sizes = saved(docs.select(key.alias("key"), text_size(text).alias("size")).groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    cuts, rows = find_cuts(sizes, options)
    shard = F.lit(0)
    for cut in cuts:  # the first key of each shard but the first
        shard = shard + (F.col("_key") >= cut).cast("int")
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    sharded = docs.select(*kept, text_size(text).alias("size"), key.alias("_key")).withColumn("shard", shard)
    return _with_slots(sharded, kept, rows, options, id_column)


def _with_slots(rows: DataFrame, kept: list[str], total: int, options: ShardOptions, id_column: str) -> DataFrame:
    """Slots by parts, so that neither a shard nor a group of equal texts is numbered in one task."""
    parts = 64 + total // (options.shards * options.rows_per_part)
    order = F.xxhash64(F.col(id_column), F.col("_key"))
    dealt = rows.withColumn("_order", order).withColumn("_part", F.coalesce(F.pmod("_order", F.lit(parts)), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_part").count()  # shards x parts rows
    starts = counts.select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_part").orderBy("_order")
    numbered = dealt.withColumn("_number", F.row_number().over(within)).join(starts, ["shard", "_part"])
    return numbered.select(*kept, "size", "shard", (F.col("_start") + F.col("_number") - 1).cast("long").alias("slot"))


# --- capacity and cuts ----------------------------------------------------------------------


@dataclass(frozen=True)
class Stretch:
    """Groups from ``low`` to below ``high``; one group only if ``single``."""

    low: int
    high: int
    size: int
    single: bool


def find_cuts(sizes: DataFrame, options: ShardOptions) -> tuple[list[int], int]:
    """First keys of the shards after the first, and the number of rows, of ``sizes(key, size, rows)``.

    The driver sees stretches of keys and divides those in which a cut may lie,
    until every cut lies between two groups. A stretch that is not divided yet
    counts as divisible at will, so a capacity found with them is never above
    the true one, and is the true one as soon as no cut lies inside such a stretch.
    """
    largest, rows = sizes.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    row = _divided(sizes, [(0, 1 << KEY_BITS)], options.first_bits)
    while True:
        line = Line(row)
        capacity = line.smallest_capacity(options.shards, largest)
        cuts = line.balanced_cuts(options.shards, capacity)
        open_ = {i for cut in (*line.greedy_cuts(options.shards, capacity), *cuts) if (i := line.inside(cut)) is not None}
        if not open_:
            return [line.key_at(cut) for cut in cuts], rows
        near = {j for i in open_ for j in range(max(0, i - options.margin), min(len(row), i + options.margin + 1)) if not row[j].single}
        found = _divided(sizes, [(row[j].low, row[j].high) for j in sorted(near)], options.more_bits)
        row = sorted([s for j, s in enumerate(row) if j not in near] + found, key=lambda s: s.low)


def _divided(sizes: DataFrame, ranges: list[tuple[int, int]], bits: int) -> list[Stretch]:
    """The groups of equally long key ranges in up to 2**bits stretches each; empty ones are left out."""
    by_width: dict[int, list[int]] = {}
    for low, high in ranges:
        by_width.setdefault(high - low, []).append(low)
    found = []
    for width, lows in by_width.items():
        shift = max(0, width.bit_length() - 1 - bits)
        step = 1 << shift
        wanted = F.shiftright("key", width.bit_length() - 1).isin([low // width for low in lows]) if len(ranges) > 1 or width < 1 << KEY_BITS else F.lit(True)
        part = sizes.where(wanted).groupBy(F.shiftright("key", shift).alias("stretch"))
        for r in part.agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect():
            single = r["low"] == r["high"]
            start = r["stretch"] * step
            found.append(Stretch(r["low"] if single else start, r["low"] + 1 if single else start + step, r["size"], single))
    return sorted(found, key=lambda s: s.low)


class Line:
    """Stretches in a row; a place is a number of bytes from its beginning."""

    def __init__(self, row: list[Stretch]):
        self.row = row
        self.ends = list(accumulate(s.size for s in row))
        self.total = self.ends[-1] if row else 0

    def allowed(self, place: int) -> int:
        """The last place up to ``place`` where a cut may be."""
        if place >= self.total:
            return self.total
        i = bisect_right(self.ends, place)  # the stretch that holds the place
        before = self.ends[i] - self.row[i].size
        return before if self.row[i].single else place

    def allowed_after(self, place: int) -> int:
        """The first place from ``place`` on where a cut may be."""
        down = self.allowed(place)
        return down if down == place else self.ends[bisect_right(self.ends, place)]

    def inside(self, place: int) -> int | None:
        """The undivided stretch that a cut at ``place`` would divide."""
        i = bisect_left(self.ends, place)
        return None if place in (0, self.total) or self.ends[i] == place else i

    def key_at(self, place: int) -> int:
        """The key with which the groups after ``place`` begin."""
        i = bisect_right(self.ends, place)
        return self.row[i].low if i < len(self.row) else 1 << KEY_BITS

    def greedy_cuts(self, shards: int, capacity: int) -> list[int]:
        cuts, place = [], 0
        for _ in range(shards):
            place = self.allowed(place + capacity)
            cuts.append(place)
        return cuts

    def smallest_capacity(self, shards: int, largest: int) -> int:
        low, high = max(largest, -(-self.total // shards)), self.total + largest
        while low < high:
            middle = (low + high) // 2
            if self.greedy_cuts(shards, middle)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def balanced_cuts(self, shards: int, capacity: int) -> list[int]:
        """Ends of all shards but the last, none above the capacity."""
        earliest, place = [self.total], self.total
        for _ in range(shards - 1):  # greedily from the right: how soon each cut may come
            place = self.allowed_after(max(0, place - capacity))
            earliest.insert(0, place)
        cuts, place = [], 0
        for i in range(shards - 1):
            ideal = place + (self.total - place) // (shards - i)
            down, up = self.allowed(ideal), self.allowed_after(ideal)
            near = down if ideal - down <= up - ideal or up > place + capacity else up
            place = max(place, earliest[i], near)
            cuts.append(place)
        return cuts
