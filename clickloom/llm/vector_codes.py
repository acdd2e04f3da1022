"""Product codes of vectors, with codebooks trained over metric trees.

Vectors are cut into parts and each part position has a codebook, trained by
Lloyd's rounds. Vectors come in blocks as they are read; within a block every
part position has a metric tree of balls over its sub-vectors, built once by the
anchors hierarchy, from the middle out: anchors at the points that are farthest
from all others take over what is closer to them; balls around neighbouring
anchors are merged upwards to one root, and anchors of many points get a hierarchy
of their own below. A ball caches the sum and the number of its points. In a round
a ball inherits from its parent the list of entries that may own a point of it and
drops those that some entry beats everywhere in the ball; a ball that is left with
one entry is wholly owned, and its cached sum and count go to that entry. Only
points of leaves with several entries left are compared one by one.

Trees are written once and read in each round; a round sends one sum per entry and
task. Everything is counted in whole numbers, so results do not depend on blocks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.storage import bound_batches, saved

BLOCKS = "block binary"
MARGIN = 1 + 1e-9


@dataclass(frozen=True)
class CodeOptions:
    """``parts`` of ``entries`` codebook entries each, trained in ``rounds``. ``block``: vectors in a
    tree, fewer if they have more than ``block_values`` components together; ``leaf``: points of an
    anchor that get no hierarchy of their own."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    block: int = 16_384
    block_values: int = 1 << 20
    leaf: int = 32


# --- trees --------------------------------------------------------------------------------


@dataclass
class Tree:
    """Balls, parents before children; the points of ball b are ``order[first[b]:end[b]]``.

    ``depth`` says how far below the root a ball lies; a leaf has no children.
    """

    order: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    end: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    sums: np.ndarray


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` to each of ``b``, exact."""
    if len(a) * len(b) < 4096:
        return ((a[:, None] - b[None]) ** 2).sum(axis=2)
    found = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        found += (a[:, k, None] - b[None, :, k]) ** 2
    return found


def anchors(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor points, owner of each point, its squared distance to the owner).

    Every new anchor is the point farthest from its owner, and takes what is
    closer to it. A point nearer to its owner than half of the gap between the
    anchors cannot change hands and is not looked at.
    """
    chosen = [0]
    owner = np.zeros(len(points), np.int64)
    apart = square_distances(points, points[:1])[:, 0]
    while len(chosen) < count:
        far = int(np.argmax(apart))
        if not apart[far]:
            break
        gap = square_distances(points[chosen], points[far : far + 1])[:, 0]
        open_ = np.flatnonzero(4 * apart > gap[owner])
        new = square_distances(points[open_], points[far : far + 1])[:, 0]
        closer = new < apart[open_]
        owner[open_[closer]] = len(chosen)
        apart[open_[closer]] = new[closer]
        chosen.append(far)
    return np.array(chosen), owner, apart


def build_tree(points: np.ndarray, leaf: int) -> Tree:
    """The hierarchy over all ``points`` (int64 rows, one at least)."""
    balls: list[tuple] = []  # pivot, radius, members of a leaf or None, children

    def grow(members: np.ndarray) -> int:
        """The root ball over these points; returns its number."""
        own = points[members]
        if len(members) <= leaf:
            return ball(own, members)
        chosen, owner, apart = anchors(own, max(2, int(np.sqrt(len(members)))))
        if len(chosen) == 1:  # all alike
            return ball(own, members)
        order = np.argsort(owner, kind="stable")
        groups = np.split(members[order], np.cumsum(np.bincount(owner, minlength=len(chosen)))[:-1])
        return merge([grow(g) if len(g) > leaf and len(g) < len(members) else ball(points[g], g) for g in groups])

    def ball(own: np.ndarray, members: np.ndarray) -> int:
        middle = np.rint(own.mean(axis=0)).astype(np.int64)
        radius = np.sqrt(((own - middle) ** 2).sum(axis=1).max())
        balls.append((middle, float(radius), members, ()))
        return len(balls) - 1

    def merge(nodes: list[int]) -> int:
        """Puts a ball around the two that fit into the smallest one, until one is left."""
        pivots = np.array([balls[n][0] for n in nodes], np.float64)
        radii = np.array([balls[n][1] for n in nodes])
        gaps = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2))
        size = (gaps + radii[:, None] + radii[None]) / 2
        np.fill_diagonal(size, np.inf)
        nodes = list(nodes)
        for _ in range(len(nodes) - 1):
            i, j = divmod(int(np.argmin(size)), len(nodes))
            shift = 0.5 + (radii[j] - radii[i]) / (2 * gaps[i, j]) if gaps[i, j] else 0.5
            pivot = np.rint(pivots[i] + (pivots[j] - pivots[i]) * min(max(shift, 0.0), 1.0))
            radius = max(np.sqrt(((pivots[k] - pivot) ** 2).sum()) + radii[k] for k in (i, j)) * MARGIN
            balls.append((pivot.astype(np.int64), float(radius), None, (nodes[i], nodes[j])))
            nodes[i], pivots[i], radii[i] = len(balls) - 1, pivot, radius
            size[j], size[:, j] = np.inf, np.inf
            gaps[i] = gaps[:, i] = np.sqrt(((pivots - pivot) ** 2).sum(axis=1))
            alive = np.isfinite(size[i]) | (np.arange(len(nodes)) == i)
            size[i] = size[:, i] = np.where(alive, (gaps[i] + radii + radius) / 2, np.inf)
            size[i, i] = np.inf
        return len(balls) - 1

    root = grow(np.arange(len(points)))
    return _laid_out(points, balls, root)


def _laid_out(points: np.ndarray, balls: list[tuple], root: int) -> Tree:
    """Balls numbered from the root, so that the points of each are consecutive."""
    rows, order, at = [], [], 0
    stack = [(root, 0, -1)]
    while stack:
        number, depth, parent = stack.pop()
        if depth < 0:  # all below it is laid out
            rows[number][3] = at
            continue
        pivot, radius, members, children = balls[number]
        rows.append([pivot, radius, at, at, depth, parent, members is not None])
        place = len(rows) - 1
        if members is None:
            stack.append((place, -1, 0))
            stack += [(c, depth + 1, place) for c in children]
        else:
            order.append(members)
            at += len(members)
            rows[place][3] = at
    pivot, radius, first, end, depth, parent, leaf = zip(*rows)
    order = np.concatenate(order)
    first, end = np.array(first), np.array(end)
    running = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)))
    return Tree(order, np.array(pivot), np.array(radius), first, end, np.array(depth), np.array(parent), np.array(leaf), running[end] - running[first])


# --- a round over one tree --------------------------------------------------------------------


def owned_balls(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their entries, points, their entries): wholly owned balls, and all other points.

    Level by level; ``ball`` and ``entry`` are the candidate lists of the level's
    balls, one after the other. An entry stays if none beats it in the whole ball:
    |x - c|^2 - |x - b|^2 is least, over a ball of radius r around p, at
    |p - c|^2 - |p - b|^2 - 2 r |b - c|. An entry that equals an earlier one is in no
    list, since ties go to the first.
    """
    entries = np.sort(np.unique(book, axis=0, return_index=True)[1])
    between = np.sqrt(square_distances(book, book).astype(np.float64)) * MARGIN
    balls, owners, loose, loose_owners = [], [], [], []
    level, entry, lengths = np.zeros(1, np.int64), entries, np.array([len(entries)])
    while len(level):
        apart, best, least = _closest(tree.pivot[level], book, entry, lengths)
        radius = np.repeat(tree.radius[level], lengths)
        kept = ~(apart - np.repeat(least, lengths) > 2 * radius * between[np.repeat(best, lengths), entry])
        left = np.add.reduceat(kept, _starts(lengths), dtype=np.int64)
        owned = (left == 1) | (tree.radius[level] == 0)
        balls.append(level[owned])
        owners.append(best[owned])
        at_end = ~owned & tree.leaf[level]
        if at_end.any():
            sizes = (tree.end - tree.first)[level[at_end]]
            members = tree.order[_ranges(tree.first[level[at_end]], sizes)]
            lists = _ranges(np.repeat(_starts(left)[at_end], sizes), np.repeat(left[at_end], sizes))
            loose.append(members)
            loose_owners.append(_closest(points[members], book, entry[kept][lists], np.repeat(left[at_end], sizes))[1])
        place = np.full(len(tree.first), -1)
        inner = np.flatnonzero(~owned & ~tree.leaf[level])
        place[level[inner]] = inner
        children = np.flatnonzero(np.where(tree.parent >= 0, place[tree.parent], -1) >= 0)
        above = place[tree.parent[children]]
        level, entry, lengths = children, entry[kept][_ranges(_starts(left)[above], left[above])], left[above]
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return flat(balls), flat(owners), flat(loose), flat(loose_owners)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i]`` and the ``lengths[i] - 1`` numbers after it, for each i."""
    return np.repeat(starts - _starts(lengths), lengths) + np.arange(lengths.sum())


def _closest(points: np.ndarray, book: np.ndarray, entry: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances to the candidates; for each point the closest one, the first of equals, and its distance."""
    apart = np.zeros(len(entry), np.int64)
    for k in range(book.shape[1]):
        apart += (np.repeat(points[:, k], lengths) - book[entry, k]) ** 2
    least = np.minimum.reduceat(apart, _starts(lengths))
    best = np.minimum.reduceat(np.where(apart == np.repeat(least, lengths), entry, len(book)), _starts(lengths))
    return apart, best, least


def sums_of(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points of each entry."""
    balls, owners, loose, loose_owners = owned_balls(tree, points, book)
    sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
    np.add.at(sums, owners, tree.sums[balls])
    np.add.at(counts, owners, (tree.end - tree.first)[balls])
    np.add.at(sums, loose_owners, points[loose])
    np.add.at(counts, loose_owners, 1)
    return sums, counts


def entries_of(tree: Tree, points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    balls, owners, loose, loose_owners = owned_balls(tree, points, book)
    found = np.empty(len(points), np.int64)
    found[loose] = loose_owners
    for ball, owner in zip(balls, owners):
        found[tree.order[tree.first[ball] : tree.end[ball]]] = owner
    return found


# --- over all vectors ---------------------------------------------------------------------------


def train_and_encode(
    vectors: DataFrame, options: CodeOptions = CodeOptions(), id_column: str = "vec_id", label_column: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, entries array<int>, error long) of each row, and the codebooks (part, entry, component).

    ``vectors`` has a column ``vector`` of whole numbers, as array<long>; rows where
    it is null take no part. The codebooks start as the parts of the rows with the
    smallest ids (rows without an id come last, equal ids in the order of their
    vectors); of fewer rows there are fewer entries. Vectors of other lengths count
    as padded with zeros, to the next multiple of ``parts``. Repeated ids and equal
    vectors are rows like any others. No rows give no rows. Numbers have to stay
    below 2**28 in size. Other columns are ignored. The codebooks are on the driver
    in each round; their size is set by the options and the length of a vector.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.where("vector is not null").select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), "vector")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // options.parts))
    start = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(options.entries).select("vector").collect()
    books = np.zeros((options.parts, len(start), width), np.int64)
    for i, (vector,) in enumerate(start):
        books[:, i].flat[: len(vector)] = vector
    blocks = saved(rows.mapInArrow(_builder(options, width), BLOCKS))
    for _ in range(options.rounds if start else 0):
        books = _moved(blocks, books)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, entries array<int>, error long"
    return blocks.mapInArrow(_encoder(books), schema), books


def _builder(options: CodeOptions, width: int):
    """Rows into blocks; each block is one value with its ids, points and trees."""

    most = max(1, min(options.block, options.block_values // (options.parts * width)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            for row in range(0, batch.num_rows, most):
                part = batch.slice(row, most)
                if count + part.num_rows > most:
                    yield _block(waiting, options, width)
                    waiting, count = [], 0
                waiting.append(part)
                count += part.num_rows
        if count:
            yield _block(waiting, options, width)

    return build


def _block(batches: list[pa.RecordBatch], options: CodeOptions, width: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    lists = table["vector"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.zeros((len(lists), options.parts * width), np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(np.arange(len(lists)), lengths), at] = lists.flatten().to_numpy()
    points = flat.reshape(len(lists), options.parts, width).transpose(1, 0, 2).copy()
    trees = [build_tree(p, options.leaf) for p in points]
    value = pickle.dumps((table.select(["id", "label"]), points.astype(_narrowest(points)), trees), protocol=5)
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["block"])


def _narrowest(points: np.ndarray) -> type:
    return np.int16 if np.abs(points).max(initial=0) < 1 << 15 else np.int32 if np.abs(points).max() < 1 << 31 else np.int64


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, list[Tree]]]:
    for batch in batches:
        for value in batch.column(0):
            table, points, trees = pickle.loads(value.as_buffer())
            yield table, points.astype(np.int64), trees


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of what they own; unused entries stay."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        sums, counts = np.zeros_like(now), np.zeros(now.shape[:2], np.int64)
        for _, points, trees in _opened(batches):
            for p, tree in enumerate(trees):
                more, times = sums_of(tree, points[p], now[p])
                sums[p] += more
                counts[p] += times
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "points", "sums"],
        )

    found = blocks.mapInArrow(add, "part long, entry long, points long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(books.shape[2])]
    moved = books.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("points").alias("points"), *total).collect():  # parts x entries rows
        moved[row["part"], row["entry"]] = [row[f"s{k}"] // row["points"] for k in range(books.shape[2])]
    shared.unpersist()
    return moved


def _encoder(books: np.ndarray):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, points, trees in _opened(batches):
            found = np.stack([entries_of(t, p, b) for t, p, b in zip(trees, points, books)], axis=1)
            error = sum(((p - b[found[:, i]]) ** 2).sum(axis=1) for i, (p, b) in enumerate(zip(points, books)))
            offsets = np.arange(0, found.size + 1, found.shape[1]).astype(np.int32)
            entries = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel().astype(np.int32)))
            own = [table[n].combine_chunks() for n in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*own, entries, pa.array(error)], ["id", "label", "entries", "error"])

    return encode


def with_group_error(codes: DataFrame, column: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: the error of all rows of the same label, those without one together."""
    groups = codes.groupBy(F.col(column).alias("_group")).agg(F.sum("error").alias("label_error"))
    return codes.join(groups, F.col(column).eqNullSafe(F.col("_group"))).drop("_group")


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
