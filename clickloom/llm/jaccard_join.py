"""Exact Jaccard self-join of documents, by pivots and regions.

Documents are sets of word shingles in the Jaccard metric, d = 1 - |x & y| /
|x | y|, and two link when d <= eps. The join goes from coarse pivots to fine
ones; every step replicates what the triangle inequality leaves open.

1. Pivots are single shingles. d(x, {s}) is 1 - 1/|x| if s is in x, else 1, so
   the pivots nearest to x are its own shingles, the first in one global order
   being its home (shingles of many documents last, else by hash). A linked
   partner lacks at most |x| - ceil(t |x|) shingles of x, so it is in the cells of
   ``k`` of the first ``|x| - ceil(t |x|) + k`` pivots of x: that is the window in
   which x is replicated. ``k`` grows with |x|, so a document that shares fewer
   cells than its smallest possible partner asks for is out, whatever a few
   common passages put beside it.
2. Within a cell, large pivots that divide all shingles between them give
   each document a vector of overlaps. The triangle inequality of the symmetric
   difference bounds the distance from below by the L1 distance of the vectors.
   Vectors of unrelated sets of ``n`` shingles are about ``1.1 sqrt(n * pivots)``
   apart, linked ones at most ``0.22 n`` (at 80 %), so there are 64 pivots at least and
   more for long documents; else these would all fall into one region.
   Pairs beyond the bound are dropped; what is left joins documents into
   regions that no link leaves. Only spanning trees are sent on.
3. A region of more than ``leaf_documents`` is split by documents as pivots: each
   document goes to the Voronoi cell of the nearest pivot and, within a window of
   2 eps, to those of the others, and the cells are split again. Documents linked
   to their pivot are one class already; they stay in the cell only if some unlinked
   document of the cell can be within eps. The small cells that are left, the leaves,
   are joined exactly on whole shingle sets.

Documents as pivots of the first step would be useless: unrelated documents are
at distance 0.98 to 1 from each other, so that every window would hold every
pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.components import connected_components
from clickloom.llm.storage import bound_batches, discard, saved
from clickloom.llm.text import NO_SPACE, mix, shingle_sets, words_of

CLASSES = 64
PROFILE = "id long, n_shingles long, d1 long, d2 long, overlaps binary, cells array<long>"
EMPTY = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class JoinOptions:
    """Links need ``100 * intersection >= percent * union`` of ``shingle``-word shingles.

    ``common``: cells of more documents have their shingle moved to the end of
    the order; ``common_limit``: at most so many, the most frequent, are moved.
    ``shared_part``: one cell in so many shingles has to be shared, besides one. All
    change the work, never the result. ``pivots``: documents that split a region of
    more than ``leaf_documents``. ``region_shingles`` bounds what a task holds: a region
    that pivots do not make smaller is joined in blocks of half as many, of which each
    meets ``block_round`` others at a time. ``filter_words``: 64-bit words of the filter that
    finds texts of regions, at most.
    """

    shingle: int = 5
    percent: int = 80
    common: int = 2
    common_limit: int = 500_000
    shared_part: int = 10
    region_shingles: int = 1_000_000
    leaf_documents: int = 8
    pivots: int = 8
    block_round: int = 8
    filter_words: int = 1 << 20

    def cells(self, n: int) -> int:
        """The window: as many first pivots as a set of ``n`` shingles is replicated to."""
        return min(n, n - -(-self.percent * n // 100) + 1 + n // self.shared_part)

    def first_cells(self, n: Column) -> Column:
        """As many first pivots of a set of ``n`` shingles have one of any linked set among its own first ones."""
        return n - F.ceil(n * self.percent / 100) + 1

    def least_shared(self, n: Column) -> Column:
        """Cells that a set of ``n`` shingles shares at least with a linked one of any size."""
        return 1 + F.floor(F.ceil(n * self.percent / 100) / self.shared_part)

    def linked(self, both, n, m):
        return 100 * both >= self.percent * (n + m - both)

    def near(self, n, m):
        """The most that the symmetric difference of linked sets can be."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)


def jaccard_components(docs: DataFrame, options: JoinOptions = JoinOptions(), id_column: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) for each row; the component is the smallest linked id.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than a
    shingle make one shingle of all of them. Null and empty texts have the empty
    set and link with nothing. Rows with a null id come back with a component of
    null. A repeated id stands for all its rows. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    common = _common_shingles(texts, options)
    whole = saved(_profiles(texts, options, common))
    linkable = whole.where("n_shingles > 0 and id is not null")
    sets = saved(linkable.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first(F.struct("n_shingles", "overlaps", "cells")).alias("p")).select("rep", "p.*"))
    profiles = saved(whole.select("id", "n_shingles", "d1", "d2"))
    discard(whole)
    regions = saved(_regions(sets, options))
    discard(sets)
    links = _join_regions(texts, regions, options)
    found = connected_components(links.unionByName(_copies(profiles.where("n_shingles > 0 and id is not null"))))
    return profiles.join(found, profiles.id == found.node, "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "id").alias("component_id")
    )


def _copies(linkable: DataFrame, parts: int = 256) -> DataFrame:
    """Links (a, b) of each id to the smallest one of its set, by way of the smallest of its part.

    A set of very many copies is dealt into parts, so that no task has all of them.
    """
    dealt = linkable.select("d1", "d2", "id", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    firsts = dealt.groupBy("d1", "d2", "part").agg(F.min("id").alias("first"))
    reps = firsts.groupBy("d1", "d2").agg(F.min("first").alias("rep"), F.collect_list("first").alias("firsts"))
    inner = dealt.join(firsts, ["d1", "d2", "part"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    outer = reps.select(F.explode("firsts").alias("a"), F.col("rep").alias("b"))
    return inner.unionByName(outer).where("a <> b")


# --- 1: cells of single shingles ------------------------------------------------------


def _common_shingles(texts: DataFrame, options: JoinOptions) -> np.ndarray:
    """The shingles, among those that hash order puts first, of more than ``common`` sets."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in words_of(batch.column(0), NO_SPACE):
                cells = [s[: len(s) * (100 - options.percent) // 100 + 1] for s in shingle_sets(words, options.shingle)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([EMPTY, *cells]).view(np.int64))], ["cell"])

    counted = texts.select("text").mapInArrow(first, "cell long").groupBy("cell").count().where(F.col("count") > options.common)
    most = saved(counted.orderBy(F.desc("count"), "cell").limit(options.common_limit).select("cell"))
    found = most.toArrow()
    discard(most)
    return np.sort(found["cell"].to_numpy().view(np.uint64))


def _profiles(texts: DataFrame, options: JoinOptions, common: np.ndarray) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(common)  # common_limit numbers at most

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = shared.value
        for batch in batches:
            for row, end, words in words_of(batch.column(1), NO_SPACE):
                sizes, digests, overlaps, cells = [], [], [], []
                for found in shingle_sets(words, options.shingle):
                    sizes.append(len(found))
                    digests.append((mix(found ^ np.uint64(0x5BD1E995)).sum(), mix(found + np.uint64(0x27D4EB2F)).sum()))
                    classes = _classes(len(found))
                    counts = np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
                    overlaps.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                    cells.append(_first_in_order(found, options.cells(len(found)), moved).view(np.int64))
                digest = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
                offsets = np.concatenate(([0], np.cumsum([len(c) for c in cells]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(sizes, pa.int64()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.array(overlaps, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *cells]))),
                    ],
                    ["id", "n_shingles", "d1", "d2", "overlaps", "cells"],
                )

    return texts.mapInArrow(profile, PROFILE)


def _classes(n: int) -> int:
    """Pivots of a set's vector: a power of two, an eighth of its shingles up to 256, then a sixteenth."""
    power = lambda x: 1 << max(0, x - 1).bit_length()
    return max(CLASSES, min(4 * CLASSES, power(-(-n // 8))), power(-(-n // 16)))


def _first_in_order(found: np.ndarray, count: int, moved: np.ndarray) -> np.ndarray:
    if not len(moved) or not len(found):
        return found[:count]
    at = np.minimum(np.searchsorted(moved, found), len(moved) - 1)
    is_common = moved[at] == found
    return np.concatenate((found[~is_common], found[is_common]))[:count]


# --- 2: regions that no link leaves -----------------------------------------------------


def _regions(sets: DataFrame, options: JoinOptions) -> DataFrame:
    """(rep, n_shingles, region) of the sets that may have a linked partner."""
    cells = sets.select("rep", "n_shingles", F.posexplode("cells").alias("at", "cell"))
    cells = cells.select("rep", "cell", (F.col("at") < options.first_cells(F.col("n_shingles"))).alias("early"))
    shared = cells.withColumn("docs", F.count("*").over(Window.partitionBy("cell"))).where("docs > 1")
    counted = shared.select("cell", "rep", "early", F.count("*").over(Window.partitionBy("rep")).alias("cells")).where("early")
    enough = F.col("cells") >= options.least_shared(F.col("n_shingles"))
    near = saved(counted.join(sets.select("rep", "n_shingles"), "rep").where(enough).select("cell", "rep"))
    members = near.join(sets.select("rep", "n_shingles", "overlaps"), "rep")
    dealt = members.repartition("cell").sortWithinPartitions("cell", "n_shingles", "rep")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rep, n, overlaps in _runs(batches):
            a, b = _candidate_forest(cell, n, _Vectors(overlaps), options)
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    edges = saved(dealt.select("cell", "rep", "n_shingles", "overlaps").mapInArrow(connect, "a long, b long").distinct())
    discard(near)
    found = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("region"))
    discard(edges)
    return found.join(sets.select("rep", "n_shingles"), "rep")


def _runs(batches: Iterator[pa.RecordBatch]):
    """Rows of whole cells, cell by cell, several small ones together."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(3)]
        rows.append(np.array(batch.column(3).to_pylist(), object))
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows)]
        cut = np.searchsorted(rows[0], rows[0][-1])
        if cut:
            yield [x[:cut] for x in rows]
        kept = [x[cut:] for x in rows]
    if kept is not None:
        yield kept


class _Vectors:
    """Overlap vectors of rows, by level: a vector of 256 classes folds into ones of 128 and 64.

    Counts end at 255, also those that are folded; that only lowers the bound.
    """

    def __init__(self, overlaps: np.ndarray):
        self.widths = np.array([len(x) for x in overlaps], np.int64)
        self.levels = {}
        width, rows = int(self.widths.max(initial=CLASSES)), np.zeros(0, np.int64)
        folded = np.zeros((0, width), np.uint8)
        while width >= CLASSES:
            own = np.flatnonzero(self.widths == width)
            matrix = np.concatenate((folded, np.frombuffer(b"".join(overlaps[own]), np.uint8).reshape(-1, width)))
            rows = np.concatenate((rows, own))
            at = np.full(len(overlaps), -1)
            at[rows] = np.arange(len(rows))
            self.levels[width] = at, matrix
            width //= 2
            folded = np.minimum(matrix[:, :width].astype(np.uint16) + matrix[:, width:], 255).astype(np.uint8)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """L1 distances of rows a and b, at the finer level that both have."""
        level, found = np.minimum(self.widths[a], self.widths[b]), np.zeros(len(a), np.int64)
        for width in np.unique(level).tolist():
            at, matrix = self.levels[width]
            pairs = np.flatnonzero(level == width)
            for first in range(0, len(pairs), max(1, (1 << 21) // width)):
                part = pairs[first : first + max(1, (1 << 21) // width)]
                x, y = matrix[at[a[part]]].astype(np.int16), matrix[at[b[part]]].astype(np.int16)
                found[part] = np.abs(x - y).sum(axis=1)
        return found


def _candidate_forest(cell: np.ndarray, n: np.ndarray, vectors: _Vectors, options: JoinOptions) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all rows of a cell which the pivots' bounds leave open."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
    sizes = np.diff(starts)
    label = np.arange(len(cell))
    small = np.repeat(sizes <= 32, sizes)
    left, right = [], []
    for step in range(1, int(sizes[sizes <= 32].max(initial=1))):
        i = np.flatnonzero((cell[:-step] == cell[step:]) & small[step:])
        i = i[_may_link(i, i + step, n, vectors, options)]
        left.append(i)
        right.append(i + step)
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    for start, size in zip(starts[:-1][sizes > 32], sizes[sizes > 32]):
        label[start : start + size] = start + _spread(start, n, vectors, size, options)
    joined = np.flatnonzero(label != np.arange(len(cell)))
    return joined, label[joined]


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, vectors: _Vectors, options: JoinOptions) -> np.ndarray:
    may = 100 * np.minimum(n[a], n[b]) >= options.percent * np.maximum(n[a], n[b])
    a, b = a[may], b[may]
    may[may] = vectors.apart(a, b) <= options.near(n[a], n[b])
    return may


def _spread(start: int, sizes: np.ndarray, vectors: _Vectors, count: int, options: JoinOptions) -> np.ndarray:
    """Labels within the cell from row ``start`` on, sorted by size: each row is compared with those not yet reached."""
    n = sizes[start : start + count]
    label = np.full(count, -1)
    rest = np.arange(count)
    while len(rest):
        root, rest, reached = rest[0], rest[1:], [rest[0]]
        label[root] = root
        while reached and len(rest):
            x = reached.pop()
            low, high = np.searchsorted(n[rest], [-(-options.percent * n[x] // 100), 100 * n[x] // options.percent + 1])
            window = rest[low:high]
            new = window[_may_link(np.full(len(window), start + x), start + window, sizes, vectors, options)]
            label[new] = root
            reached.extend(new.tolist())
            rest = rest[label[rest] < 0]
    return label


# --- 3: exact joins of regions -------------------------------------------------------------


def _join_regions(texts: DataFrame, regions: DataFrame, options: JoinOptions) -> DataFrame:
    """Links (a, b) that connect all documents linked within regions."""
    own = _may_be_among(texts, "id", regions.select("rep"), options)
    chosen = own.join(regions, own.id == regions.rep).select("region", "rep", "text", F.xxhash64("text").alias("copy"))
    chosen = saved(chosen.dropDuplicates(["region", "rep", "copy"]).drop("copy"))
    large = saved(regions.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("weight")).where(_is_large(options)))
    links = []
    if large.take(1):
        members = chosen.join(large, "region", "left_semi").mapInArrow(_encoder(options), "region long, rep long, shingles binary")
        links = _split_regions(saved(members), options)
    links.append(saved(_join_leaves(chosen.join(large, "region", "left_anti").select("region", "rep", "text"), options)))
    discard(chosen)
    return reduce(DataFrame.unionByName, links)


def _may_be_among(rows: DataFrame, column: str, ids: DataFrame, options: JoinOptions) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in the only column of ``ids``.

    Rows are wide and few are asked for, so they are tested where they are read and
    not shuffled first. A filter of two bits an id, 16 times as many in all up to
    ``filter_words``, lets all of ``ids`` through and some others, which a join drops.
    """
    spark, count = rows.sparkSession, ids.count()
    words = min(options.filter_words, 1 << max(6, (count // 4).bit_length()))

    def places(column: str) -> list[tuple[Column, Column]]:
        h = F.xxhash64(F.col(column).cast("long"))
        at = lambda by, most: F.shiftrightunsigned(h, by).bitwiseAND(F.lit(most - 1)).cast("int")
        return [(at(0, words), at(58, 64)), (at(24, words), at(50, 64))]

    each = F.explode(F.array(*[F.struct(word.alias("word"), bit.alias("bit")) for word, bit in places(ids.columns[0])])).alias("p")
    bits = saved(ids.select(each).groupBy("p.word").agg(F.expr("bit_or(shiftleft(1L, p.bit))").alias("bits")))
    found, filter_ = bits.toArrow(), np.zeros(words, np.int64)
    discard(bits)
    filter_[found["word"].to_numpy()] = found["bits"].to_numpy()
    one = spark.createDataFrame(pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(filter_))}))
    passed = [F.getbit(F.get("_bits", word), bit) == 1 for word, bit in places(column)]
    return rows.join(F.broadcast(one), passed[0] & passed[1]).select(*rows.columns)


def _is_large(options: JoinOptions) -> Column:
    """Whether a region is split: by its documents, or by its shingles if there are more than two documents."""
    return (F.col("rows") > options.leaf_documents) | ((F.col("weight") > options.region_shingles) & (F.col("rows") > 2))


def _sets(batch: pa.RecordBatch, options: JoinOptions) -> Iterator[np.ndarray]:
    """The shingle sets of the third column, which are texts or encoded sets."""
    column = batch.column(2)
    if pa.types.is_binary(column.type):
        for value in column:
            yield np.frombuffer(value.as_buffer(), np.uint64)
    else:
        for _, _, words in words_of(column, NO_SPACE):
            yield from shingle_sets(words, options.shingle)


def _encoder(options: JoinOptions):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                sets = pa.array([s.tobytes() for s in _sets(part, options)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["region", "rep", "shingles"])

    return encode


def _join_leaves(members: DataFrame, options: JoinOptions) -> DataFrame:
    """Spanning trees of the links within each region, which is held by one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, reps, sets = None, [], []

        def done() -> pa.RecordBatch:
            label = linked_labels(sets, options)
            at = np.flatnonzero(label != np.arange(len(label)))
            ids = np.array(reps, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], ["a", "b"])

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, rep, found in zip(keys, ids, _sets(batch, options)):
                if key != region:
                    if len(reps) > 1:
                        yield done()
                    region, reps, sets = key, [], []
                reps.append(rep)
                sets.append(found.copy())
        if len(reps) > 1:
            yield done()

    dealt = members.repartition("region").sortWithinPartitions("region", "rep")
    return dealt.mapInArrow(join, "a long, b long")


def linked_labels(sets: list[np.ndarray], options: JoinOptions) -> np.ndarray:
    """For each set the first one it is linked with, through others if need be.

    Overlaps are counted on posting lists. A set that has been reached is not
    compared again, so that a dense class costs little more than its size.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    ranks = np.unique(np.concatenate([EMPTY, *sets]), return_inverse=True)[1].astype(np.int32)
    owners = np.repeat(np.arange(count, dtype=np.int32), sizes)
    label = np.full(count, -1)
    listed, alive = 0, count
    for root in range(count):
        if label[root] >= 0:
            continue
        label[root], reached = root, [root]
        while reached:
            if alive < 0.5 * listed or not listed:  # posting lists of what is not reached yet
                open_ = label[owners] < 0
                order = np.argsort(ranks[open_], kind="stable")
                posted = owners[open_][order]
                first = np.searchsorted(ranks[open_][order], np.arange(ranks.max() + 2) if len(ranks) else [0])
                listed = alive = max(1, int((label < 0).sum()))
            x = reached.pop()
            own = ranks[bounds[x] : bounds[x + 1]]
            lengths = first[own + 1] - first[own]
            total = int(lengths.sum())
            if not total:
                continue
            at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
            both = np.bincount(posted[at], minlength=count)
            new = np.flatnonzero((both > 0) & (label < 0))
            new = new[options.linked(both[new], sizes[x], sizes[new])]
            label[new] = root
            alive -= len(new)
            reached.extend(new.tolist())
    return label


def _split_regions(members: DataFrame, options: JoinOptions) -> list[DataFrame]:
    """Links of large regions, by Voronoi cells around documents, again and again.

    A region whose cells would hold nearly all of it again is joined in blocks,
    which need no pivots; the others go on as their cells.
    """
    links, level = [], 0
    while True:
        sizes = members.groupBy("region").agg(F.count("*").alias("rows"), _weight().alias("weight"))
        large = saved(sizes.where(_is_large(options)))
        links.append(saved(_join_leaves(members.join(large, "region", "left_anti"), options)))
        if not large.take(1):
            discard(members)
            return links
        big = members.join(large, "region")
        found, cells, measured = _voronoi_cells(big, level, options)
        links.append(saved(found))
        held = cells.groupBy("parent", "region").agg(F.sum("size").alias("w")).groupBy("parent")
        held = held.agg(F.sum("w").alias("sum"), F.sum(F.col("w") * F.col("w")).alias("squares"))
        helps = (F.col("squares") <= F.col("weight") * F.col("weight") / 2) & (F.col("sum") <= 1.5 * F.col("weight"))
        judged = saved(large.join(held, large.region == held.parent, "left").select(large.region, F.coalesce(helps, F.lit(True)).alias("helps")))
        if judged.where("not helps").take(1):
            links.extend(_join_blocks(big.join(judged.where("not helps"), "region", "left_semi").select("region", "rep", "shingles", "weight"), options))
        split = judged.where("helps").select(F.col("region").alias("parent"))
        # a document may be a pivot of two regions: their cells become one
        next_ = cells.join(split, "parent", "left_semi").dropDuplicates(["region", "rep", "copy"])
        next_ = saved(next_.join(measured.selectExpr(*_KEY, "shingles"), ["parent", "rep", "copy"]).select("region", "rep", "shingles"))
        discard(members, measured)
        members, level = next_, level + 1


def _voronoi_cells(big: DataFrame, level: int, options: JoinOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of documents with pivots, the cells (parent, region, rep, copy, size) of the regions, and the saved sets.

    Every pair linked within a region is in one of its cells, or both are linked with a pivot.
    Cells have no shingles, of which there would be one copy for each pivot.
    """
    eps = 1 - options.percent / 100
    order = F.xxhash64("rep", F.lit(level))
    parts = F.ceil(F.greatest(F.col("rows") / 1000, 2 * F.col("weight") / options.region_shingles))
    big = big.withColumn("parts", parts).withColumn("part", F.pmod(order, "parts"))
    picked = big.groupBy("region", F.pmod(order, F.lit(options.pivots)).alias("p")).agg(
        F.min_by(F.struct("rep", "shingles"), F.struct(order, "rep")).alias("pivot"), F.max("parts").alias("parts")
    )
    pivots = picked.select(F.col("region").alias("cell"), "pivot.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    measured = saved(
        big.select("region", "part", "rep", "shingles").groupBy("region", "part").cogroup(pivots.groupBy("cell", "block")).applyInArrow(
            _distances, "region long, rep long, shingles binary, pivots array<long>, distances array<double>"
        )
    )
    near, x = F.array_min("distances").alias("near"), F.explode(F.arrays_zip("pivots", "distances")).alias("x")
    each = measured.selectExpr("*", *_KEY).select("parent", "rep", "copy", (F.octet_length("shingles") / 8).alias("size"), near, x)
    each = each.select("*", F.col("x.pivots").alias("region"), F.col("x.distances").alias("apart"))
    links = each.where((F.col("apart") <= eps + 1e-9) & (F.col("rep") != F.col("region")))
    dealt = each.where(F.col("apart") <= F.col("near") + 2 * eps + 1e-9)
    linked = F.col("apart") <= eps - 1e-9
    outside = dealt.where(~linked).groupBy("parent", "region").agg(F.min("apart").alias("outside"))
    kept = dealt.join(outside, ["parent", "region"]).where(~linked | (F.col("apart") >= F.col("outside") - eps - 1e-9))
    return links.select(F.col("rep").alias("a"), F.col("region").alias("b")), kept.select("parent", "region", "rep", "copy", "size"), measured


#: A row of a region that has been split.
_KEY = "region as parent", "rep", "xxhash64(shingles) as copy"


def _weight() -> Column:
    """Shingles of encoded sets."""
    return F.sum(F.octet_length("shingles") / 8)


def _distances(left: pa.Table, right: pa.Table) -> pa.Table:
    pivots = [np.frombuffer(x, np.uint64) for x in right["shingles"].to_pylist()]
    ids = right["rep"].to_pylist()
    apart = []
    for shingles in left["shingles"].to_pylist():
        own = np.frombuffer(shingles, np.uint64)
        both = [len(np.intersect1d(own, p, assume_unique=True)) for p in pivots]
        apart.append([1 - b / max(1, len(own) + len(p) - b) for b, p in zip(both, pivots)])
    return pa.table(
        {
            "region": left["region"],
            "rep": left["rep"],
            "shingles": left["shingles"],
            "pivots": pa.array([ids] * left.num_rows, pa.list_(pa.int64())),
            "distances": pa.array(apart, pa.list_(pa.float64())),
        }
    )


def _join_blocks(members: DataFrame, options: JoinOptions) -> list[DataFrame]:
    """Large regions in pairs of blocks of half of ``region_shingles``.

    Every block meets all the others, so the pairs hold a region as many times as it
    has blocks. They are made some at a time: blocks i and j meet at step i + j.
    """
    blocks = F.ceil(2 * F.col("weight") / options.region_shingles).cast("int")
    sized = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    most, links = sized.agg(F.max("blocks")).first()[0], []
    for first in range(0, most, options.block_round):
        last = F.least(F.lit(first + options.block_round), "blocks") - 1
        step = F.explode(F.sequence(F.lit(first), last)).alias("step")
        pairs = sized.where(F.col("blocks") > first).select("region", "rep", "shingles", "block", "blocks", step)
        other = F.pmod(F.col("step") - F.col("block"), "blocks")
        low, high = F.least("block", other).cast("long"), F.greatest("block", other).cast("long")
        links.append(saved(_join_leaves(pairs.select(F.xxhash64("region", low, high).alias("region"), "rep", "shingles"), options)))
    return links


def keep_representatives(docs: DataFrame, options: JoinOptions = JoinOptions(), id_column: str = "doc_id") -> DataFrame:
    """``docs`` without all but the smallest id of each class; repeated rows stay once.

    Documents with a null id or without words are in no class and stay; of rows with a
    null id all stay, also those of equal text.
    """
    classes = jaccard_components(docs, options, id_column)
    dropped = saved(classes.where(F.col("component_id") != F.col(id_column)).select(id_column).distinct())
    copy = F.struct(F.xxhash64(F.col("text").cast("string")), F.when(F.col(id_column).isNull(), F.monotonically_increasing_id()))
    return docs.join(dropped, id_column, "left_anti").withColumn("_copy", copy).dropDuplicates([id_column, "_copy"]).select(*docs.columns)
