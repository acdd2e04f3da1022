"""Exact top-k search by aggregation without random access.

Vectors are dealt into blocks; a block keeps one list per dimension, sorted by
component. A query reads each list from the end where its own component gives
high products, all lists to the same depth. A vector's score so far, plus the
last value read from each list where it has not been seen, is an upper bound;
plus the worst value of the list, a lower one. Reading goes deeper until the
vectors whose upper bound reaches the k-th lower bound are few; all others cannot
qualify. The scores of those few are then resolved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.storage import saved


@dataclass(frozen=True)
class SearchOptions:
    """``block``: vectors, or queries, that a task holds about; ``first_depth``: share of the lists
    read in the first round, doubled in each that follows; ``few``: candidates per result, below which
    reading stops."""

    k: int = 5
    block: int = 4096
    queries_at_once: int = 64
    first_depth: float = 1 / 8
    few: int = 8


def whole_components(vector: Column, factor: int = 256) -> Column:
    """floor(factor * component) of each; null for a vector with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def search(vectors: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query.

    ``vectors`` and ``queries`` are (vec_id, vector array<long>). A query is not
    its own candidate; ties go to the smaller id. Rows with a null id or vector
    take no part. Vectors of other lengths count as padded with zeros. Equal
    vectors are searched once and of their ids only the first k + 1 can matter. A
    query id that repeats with equal vectors counts once. Scores have to stay
    below 2**53. The work is all queries against all vectors, in blocks.
    """
    k = options.k
    known = vectors.where("vec_id is not null and vector is not null").select("vec_id", "vector")
    asked = saved(queries.where("vec_id is not null and vector is not null").select(F.col("vec_id").alias("query_id"), "vector").distinct())
    distinct = saved(_first_ids(known, k + 1))
    vector_blocks, query_blocks = (max(1, -(-df.count() // options.block)) for df in (distinct, asked))
    left = distinct.select(
        "ids", "vector", F.pmod(F.xxhash64("vector"), F.lit(vector_blocks)).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q")
    )
    right = asked.select(
        "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vector_blocks - 1).cast("long"))).alias("v")
    )
    pairs = left.groupBy("v", "q").cogroup(right.groupBy("v", "q"))
    best = pairs.applyInArrow(lambda x, y: _search_block(x, y, options), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _first_ids(vectors: DataFrame, count: int) -> DataFrame:
    """(vector, ids): the ``count`` smallest ids of each vector.

    The ids are dealt into parts by hash, so that a vector of very many rows is
    not sorted in one task: its parts keep ``count`` each before they meet.
    """
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, count)
    numbered = vectors.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("vector", "part").orderBy("vec_id")))
    return numbered.where(F.col("n") <= count).groupBy("vector").agg(smallest(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width))
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(lists)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, at] = lists.flatten().to_numpy()
    return out


def _search_block(left: pa.Table, right: pa.Table, options: SearchOptions) -> pa.Table:
    found: list[tuple[int, int, int]] = []
    if left.num_rows and right.num_rows:
        width = max(int(np.max([len(v) for v in t["vector"]])) for t in (left, right))
        vectors, queries = _matrix(left["vector"], width), _matrix(right["vector"], width)
        ids, asked = left["ids"].to_pylist(), right["query_id"].to_pylist()
        lists = SortedLists(vectors)
        for i in range(0, len(asked), options.queries_at_once):
            for j, rows in enumerate(lists.candidates(queries[i : i + options.queries_at_once], options), i):
                query, scores = asked[j], vectors[rows] @ queries[j]
                every = sorted((-int(s), v) for s, r in zip(scores, rows) for v in ids[r] if v != query)
                found += [(query, v, -s) for s, v in every[: options.k]]
    columns = list(zip(*found)) or [(), (), ()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})


class SortedLists:
    """Per dimension, all vectors of a block in order of their component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(vectors))[:, None].repeat(vectors.shape[1], 1), axis=0)

    def candidates(self, queries: np.ndarray, options: SearchOptions) -> list[np.ndarray]:
        """For each query, rows among which are all with one of the k + 1 highest scores, ties included.

        One more than k, as a query may be its own candidate.
        """
        count = len(self.vectors)
        wanted = min(count, options.k + 1)
        few = options.few * wanted
        found: list[np.ndarray | None] = [None] * len(queries)
        open_ = np.arange(len(queries))
        depth = max(1, int(count * options.first_depth))
        while len(open_):
            if depth >= count or count <= few:
                for i in open_:
                    found[i] = self._at_end(queries[i], wanted)
                break
            lower, upper = self._bounds(queries[open_], depth)
            floor = np.partition(lower, count - wanted, axis=0)[count - wanted]
            alive = upper >= floor
            for j in np.flatnonzero(alive.sum(axis=0) <= few):
                found[open_[j]] = np.flatnonzero(alive[:, j])
            open_ = open_[alive.sum(axis=0) > few]
            depth *= 2
        return found

    def _bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (vectors x queries) after ``depth`` entries of each list.

        Entries are read from the top where the query's component is positive,
        from the bottom where it is negative.
        """
        count = len(self.vectors)
        lower = upper = 0
        for part, seen, last, worst in (
            (np.maximum(queries, 0), self.place >= count - depth, self.sorted[count - depth], self.sorted[0]),
            (np.minimum(queries, 0), self.place < depth, self.sorted[depth - 1], self.sorted[-1]),
        ):
            scores = np.where(seen, self.vectors, 0) @ part.T
            unseen = (~seen).astype(np.float64)
            lower = lower + scores + unseen @ (part * worst).T
            upper = upper + scores + unseen @ (part * last).T
        return lower, upper

    def _at_end(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Lists read to their ends: both bounds are the scores."""
        scores = self.vectors @ query
        return np.flatnonzero(scores >= np.partition(scores, len(scores) - wanted)[len(scores) - wanted])
