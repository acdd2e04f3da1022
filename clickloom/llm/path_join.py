"""Near-duplicate classes by a chosen-path set similarity join.

Documents are sets of word shingles, and each set has ``hashes`` minwise tokens:
two sets agree in a token as often as their Jaccard similarity says. A tree starts
with all sets in one node. A node chooses ``paths`` of the tokens and branches on
their values, so a set goes down one branch per chosen token, and sets that share
little part soon. Two linked sets at the threshold stay together on some path to the
end with a probability that does not fall with the depth, as ``paths`` times the
threshold is over one; independent trees are repeated until what is missed is less
than ``1 - recall``.

A node of at most ``leaf`` sets is compared exhaustively: all pairs by their tokens,
and what may be linked by its full sets. A larger node is compared in pieces of that
size, each together with one set of the node as its centre, so that a dense group
becomes one class at once; then it branches on. A node whose sets are all of one
class is done: links within a class change nothing.

Branching pays while a branch holds less than ``1 / paths`` of its node. A node with a
larger branch is dense and is settled instead: the sets outside the class of its
centre are compared with everything in it, in blocks. So is a node with few sets
outside that class, or with few that have not met in one settled node: pairs that
have are not compared again. What is still large at the last level is compared in
blocks too, so no node is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.components import connected_components
from clickloom.llm.storage import bound_batches, saved
from clickloom.llm.text import NO_SPACE, mix, shingle_sets, words_of
from clickloom.operators.filters import keep_keys

PROFILE = "id long, n_shingles long, d1 long, d2 long, tokens binary"
TOKEN_BYTES = 4


@dataclass(frozen=True)
class PathOptions:
    """Links need ``100 * intersection >= percent * union`` of ``shingle``-word shingles.

    ``hashes``: minwise tokens of a set. ``paths``: those that a node branches on.
    ``recall``: least probability to find a link at the threshold; it sets the number
    of trees. ``leaf``: sets that are compared all with all. ``leaf_shingles``:
    shingles of full sets in one task; more are compared in blocks. ``levels``: depth
    after which large nodes are compared in blocks. ``agreeing``: share of the tokens
    in which a pair has to agree for its full sets to be compared; at the threshold
    all but one pair in 50 million do at a half of 64.
    """

    shingle: int = 4
    percent: int = 80
    hashes: int = 64
    paths: int = 3
    recall: float = 0.999999
    leaf: int = 1000
    leaf_shingles: int = 1_000_000
    levels: int = 8
    agreeing: float = 0.5

    @property
    def tree_recall(self) -> float:
        """Probability that a link at the threshold survives to the end of some path, at any depth."""
        found = 1.0
        for _ in range(1000):
            found = 1 - (1 - self.percent / 100 * found) ** self.paths
        return found

    @property
    def trees(self) -> int:
        missed = 1 - self.tree_recall
        return ceil(log(1 - self.recall) / log(missed)) if 1 - self.recall < missed < 1 else 1

    def branches(self, level: int) -> Column:
        """The branches of a set with ``tokens`` in ``node``, or at the roots of the trees.

        The trees start on tokens of their own; further levels have tokens of their
        own too, from which the node's number picks.
        """
        first = self.trees * self.paths
        width = (self.hashes - first) // self.levels
        if width < self.paths:
            raise ValueError(f"{self.hashes} hashes are too few for {self.trees} trees of {self.levels} levels")
        if level == 0:
            picked = [(F.lit(t).cast("long"), F.lit(t * self.paths + p)) for t in range(self.trees) for p in range(self.paths)]
        else:
            within = [F.pmod(F.xxhash64("node", F.lit(level)) + p, F.lit(width)).cast("int") for p in range(self.paths)]
            picked = [(F.col("node"), F.lit(first + (level - 1) * width) + w) for w in within]
        return F.array(*[F.xxhash64(node, token, F.col("tokens").substr(token * TOKEN_BYTES + 1, F.lit(TOKEN_BYTES))) for node, token in picked])

    def linked(self, both, n, m):
        return 100 * both >= self.percent * (n + m - both)


def near_classes(docs: DataFrame, options: PathOptions = PathOptions(), id_column: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of each row; the component is the smallest id that links reach.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than a
    shingle make one shingle of all. Null and empty texts have the empty set and link
    with nothing. Rows of a null id come back with a component of null. A repeated id
    stands for all its rows. Equal sets are one class whatever the trees find. Words
    and shingles are compared by 64-bit hashes. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    profiles = saved(texts.mapInArrow(_profiler(options), PROFILE))
    known = profiles.where("n_shingles > 0 and id is not null")
    sets = saved(
        known.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.min("tokens").alias("tokens")).select("rep", "n", "tokens")
    )
    classes = connected_components(_grow(texts, sets, options).unionByName(_copies(known)))
    return profiles.join(classes, profiles.id == classes.node, "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "id").alias("component_id")
    )


def _copies(known: DataFrame) -> DataFrame:
    """Links (a, b) of each id with the smallest one of an equal set.

    Copies are dealt into parts, so that a set of very many rows meets in parts
    that are linked with each other through their smallest ids.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(256))
    parts = known.select("d1", "d2", "id", part.alias("part")).distinct()
    lowest = parts.groupBy("d1", "d2", "part").agg(F.min("id").alias("low"), F.count("*").alias("ids"))
    inside = parts.join(lowest.where("ids > 1"), ["d1", "d2", "part"]).where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    across = lowest.groupBy("d1", "d2").agg(F.min("low").alias("first"), F.collect_set("low").alias("lows")).where(F.size("lows") > 1)
    across = across.select(F.explode("lows").alias("a"), F.col("first").alias("b")).where("a <> b")
    return inside.unionByName(across)


# --- sets -----------------------------------------------------------------------------------


def _profiler(options: PathOptions):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in words_of(batch.column(1), NO_SPACE):
                sets = list(shingle_sets(words, options.shingle))
                sizes = np.array([len(s) for s in sets], np.int64)
                digests = np.array([(mix(s ^ np.uint64(0x5BD1E995)).sum(), mix(s + np.uint64(0x27D4EB2F)).sum()) for s in sets], np.uint64)
                digests = digests.reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(sizes),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.array([t.tobytes() for t in minwise_tokens(sets, sizes, options.hashes)], pa.binary()),
                    ],
                    ["id", "n_shingles", "d1", "d2", "tokens"],
                )

    return profile


def minwise_tokens(sets: list[np.ndarray], sizes: np.ndarray, count: int) -> np.ndarray:
    """The least of ``count`` hashes over each set; zeros for an empty one."""
    tokens = np.zeros((len(sets), count), np.uint32)
    filled = np.flatnonzero(sizes)
    if len(filled):
        values = mix(np.concatenate([sets[i] for i in filled]) + np.uint64(0x9E3779B97F4A7C15))
        low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes[filled]) - sizes[filled]
        rng = np.random.default_rng(20)  # the same hashes in every task
        for k, (odd, mask) in enumerate(rng.integers(0, 1 << 32, (count, 2), np.uint32)):
            tokens[filled, k] = np.minimum.reduceat((low ^ mask) * (odd | np.uint32(1)) + high * np.uint32(2 * k + 1), starts)
    return tokens


# --- trees ------------------------------------------------------------------------------------


@dataclass
class Known:
    """What the trees have found so far: ``links`` (a, b), ``classes`` (node, component) that all or
    some of them make, and the settled node, if any, in which a set has met all others (rep, settled)."""

    links: DataFrame
    classes: DataFrame | None = None
    settled: DataFrame | None = None

    def label(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``class`` of their set and its settled node, or one of its own."""
        columns = [*rows.columns]
        if self.classes is not None:
            rows = rows.join(self.classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
        if self.settled is not None:
            rows = rows.join(self.settled, "rep", "left")
        of = F.coalesce("component", "rep") if self.classes is not None else F.col("rep")
        own = F.xxhash64(F.lit("own"), "rep")
        met = F.coalesce("settled", own) if self.settled is not None else own
        return rows.select(*columns, of.alias("class"), met.alias("met"))

    def add_settled(self, settled: DataFrame) -> None:
        """Notes that the sets of each ``node`` have met each other; the largest node of a set counts."""
        rows = settled.select("rep", "node", "members")
        if self.settled is not None:
            rows = rows.unionByName(self.settled.select("rep", F.col("settled").alias("node"), F.lit(0).cast("long").alias("members")))
        self.settled = saved(rows.groupBy("rep").agg(F.max_by("node", F.struct("members", "node")).alias("settled")))


def _grow(texts: DataFrame, sets: DataFrame, options: PathOptions) -> DataFrame:
    """Links (a, b) from all trees, which grow side by side."""
    known = Known(sets.sparkSession.createDataFrame([], "a long, b long"))
    keyed, above = [], sets
    for level in range(options.levels + 1):
        last = level == options.levels
        branches = above.select("rep", F.explode(options.branches(min(level, options.levels - 1))).alias("node"))
        nodes = saved(_with_sizes(saved(known.label(branches))))
        groups = _candidates(reduce(DataFrame.unionByName, [*keyed, _pieces(nodes, options, last)]), sets, options)
        compared = groups.count()
        if compared:
            found = _confirmed(groups, compared, texts, options)
            known.links = known.links.unionByName(found)
            # deeper levels find few links; the classes may lag behind them
            if level == 0 and not found.isEmpty():
                known.classes = connected_components(known.links)
        if keyed:
            known.add_settled(settled)
        large = nodes.where(F.col("members") > options.leaf).select("node", "rep", "center", "members")
        if level > 0:
            large = large.unionByName(waiting.select("node", "rep", "center", "members"))
        if last or large.isEmpty():
            return known.links
        mixed = _with_blocks(saved(known.label(large)), sets, level + 1, options)
        settled, waiting = mixed.where("settle and first"), mixed.where("settle and not first")
        keyed, above = [_met_in_blocks(settled)], mixed.where("not settle").join(sets, "rep")


def _with_sizes(rows: DataFrame) -> DataFrame:
    """The nodes of several classes, with their number of ``members`` and a ``center`` among them.

    A node whose sets have all met in one settled node is left out as well.
    """
    center = F.min_by("rep", F.xxhash64("rep")).alias("center")
    sizes = rows.groupBy("node").agg(F.count("*").alias("members"), center, *_extremes()).where(OPEN)
    return rows.join(sizes.select("node", "members", "center"), "node")


OPEN = "low_class <> high_class and low_met <> high_met"


def _extremes() -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in ("class", "met") for n, f in (("low", F.min), ("high", F.max))]


def _pieces(nodes: DataFrame, options: PathOptions, last: bool) -> DataFrame:
    """(key, rep, class, met): what is compared with each other. A large node's center is in all its pieces."""
    small = nodes.where(F.col("members") <= options.leaf).select(F.col("node").alias("key"), "rep", "class", "met")
    large = nodes.where(F.col("members") > options.leaf)
    if last:
        return small.unionByName(_block_pairs(large, "node", F.ceil(2 * F.col("members") / options.leaf)))
    pieces = F.ceil(F.col("members") / options.leaf)
    dealt = large.select(F.xxhash64("node", F.pmod(F.xxhash64("rep"), pieces)).alias("key"), "rep", "class", "met")
    centers = large.where("rep = center").select("node", "rep", "class", "met", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    centers = centers.select(F.xxhash64("node", "piece").alias("key"), "rep", "class", "met")
    return small.unionByName(dealt).unionByName(centers)


def _block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """(key, rep, class, met): every pair of a group's rows meets under some key, in blocks by hash."""
    blocks = F.greatest(blocks.cast("long"), F.lit(1).cast("long"))
    own = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return pairs.select(F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"), "blocks").alias("key"), "rep", "class", "met")


def _with_blocks(rows: DataFrame, sets: DataFrame, level: int, options: PathOptions) -> DataFrame:
    """Sets of large nodes that are open yet, after their pieces were compared.

    ``settle`` says whether the node is to be compared in blocks; sets ``outside``
    what the center stands for are dealt into ``outer`` blocks, the others into
    ``inner`` ones. Of the nodes to settle with centers of one class the largest is
    ``first``, as are those with little to compare: after it the others have little
    left, too. At the last level all are settled, as they come.
    """
    at_center = F.col("rep") == F.col("center")
    mains = [F.max(F.when(at_center, F.col(c))).alias(f"main_{c}") for c in ("class", "met")]
    others = [F.count_if(F.col(c) != F.col(f"main_{c}")).alias(f"other_{c}") for c in ("class", "met")]
    state = rows.groupBy("node").agg(*mains, *_extremes()).where(OPEN).select("node", "main_class", "main_met")
    mixed = saved(rows.join(state, "node"))
    branches = mixed.join(sets, "rep").select("node", F.explode(options.branches(min(level, options.levels - 1))).alias("branch"))
    largest = branches.groupBy("node", "branch").count().groupBy("node").agg(F.max("count").alias("branch"))
    last = F.lit(level == options.levels)
    outsiders = F.least("other_class", "other_met")
    settle = (outsiders <= options.leaf) | (F.col("branch") * options.paths > F.col("members")) | last
    nodes = mixed.groupBy("node", "main_class", "members").agg(*others).join(largest, "node")
    nodes = saved(
        nodes.select(
            "node",
            "main_class",
            "members",
            (F.col("other_class") <= F.col("other_met")).alias("by_class"),
            settle.alias("settle"),
            ((outsiders <= options.leaf) | last).alias("now"),
            F.ceil(outsiders / options.leaf).alias("outer"),
            F.ceil((F.col("members") - outsiders) / options.leaf).alias("inner"),
        )
    )
    largest = nodes.where("settle").groupBy("main_class").agg(F.max_by("node", F.struct("members", "node")).alias("largest"))
    first = (F.col("now") | (F.col("node") == F.col("largest"))).alias("first")
    nodes = nodes.join(largest, "main_class", "left").select("node", "by_class", "settle", "outer", "inner", first)
    outside = F.when(F.col("by_class"), F.col("class") != F.col("main_class")).otherwise(F.col("met") != F.col("main_met"))
    return saved(mixed.join(nodes, "node").withColumn("outside", outside).drop("main_class", "main_met"))


def _met_in_blocks(mixed: DataFrame) -> DataFrame:
    """(key, rep, class, met): blocks outside what the center stands for meet each other and every block inside it."""
    first, blocks = F.when(F.col("outside"), 0).otherwise(F.col("outer")), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))
    partners = F.when(F.col("outside"), F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    met = mixed.select(
        "node",
        "rep",
        "class",
        "met",
        (first + F.pmod(F.xxhash64("rep"), blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), partners - 1)).alias("other"),
    )
    return met.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "rep", "class", "met")


# --- small nodes --------------------------------------------------------------------------------


def _candidates(keyed: DataFrame, sets: DataFrame, options: PathOptions) -> DataFrame:
    """(group, rep, class, met, n): sets of several classes that their tokens leave open, each group once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps, classes, met, n, values in _by_key(batches):
            tokens = np.frombuffer(b"".join(values), np.uint32).reshape(len(reps), options.hashes)
            label = plausible_labels(tokens, classes, met, n, options)
            sizes = np.bincount(label, minlength=len(label))
            at = np.flatnonzero(sizes[label] > 1)
            if not len(at):
                continue
            names = np.zeros(len(label), np.uint64)
            np.add.at(names, label[at], mix(reps[at].view(np.uint64)))
            columns = [names[label[at]].view(np.int64), *(c[at] for c in (reps, classes, met, n))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["group", "rep", "class", "met", "n"])

    rows = keyed.distinct().join(sets, "rep").select("key", "rep", "class", "met", "n", "tokens")
    dealt = rows.repartition("key").sortWithinPartitions("key", "rep")
    return saved(dealt.mapInArrow(compare, "group long, rep long, class long, met long, n long").distinct())


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(reps, classes, settled nodes, sizes, values) of each key; rows come sorted by it."""
    key, parts = None, []

    def whole():
        columns = [np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (1, 2, 3, 4)]
        return (*columns, [v for p in parts for v in p.column(5).to_pylist()])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else []
        for start, end in zip(cuts[:-1], cuts[1:]):
            if keys[start] != key:
                if parts:
                    yield whole()
                key, parts = keys[start], []
            parts.append(batch.slice(start, end - start))
    if parts:
        yield whole()


def plausible_labels(tokens: np.ndarray, classes: np.ndarray, met: np.ndarray, n: np.ndarray, options: PathOptions) -> np.ndarray:
    """For each set the first one it is connected with by pairs that may be linked, of different classes and not met before."""
    if len(tokens) <= 32:
        agree = (tokens[:, None] == tokens[None]).sum(axis=2)
    else:
        agree = np.zeros((len(tokens), len(tokens)), np.int16)
        for column in tokens.T:
            agree += column[:, None] == column[None]
    open_ = agree >= options.agreeing * options.hashes
    open_ &= 100 * n[:, None] >= options.percent * n[None]
    open_ &= 100 * n[None] >= options.percent * n[:, None]
    open_ &= (classes[:, None] != classes[None]) & (met[:, None] != met[None])
    label = np.arange(len(tokens))
    a, b = np.nonzero(open_)
    while len(a) and (label[a] != label[b]).any():
        np.minimum.at(label, a, label[b])
        label = label[label]
    return label


def _confirmed(groups: DataFrame, count: int, texts: DataFrame, options: PathOptions) -> DataFrame:
    """Links (a, b) that join what is linked within the groups of ``count`` rows, on full sets."""
    wanted = groups.select(F.col("rep").alias("id")).distinct()
    found = keep_keys(texts, wanted, "id", count, few=0).withColumn("copy", F.xxhash64("text")).dropDuplicates(["id", "copy"])
    encoded = found.select(F.col("id").alias("rep"), "text").mapInArrow(_encoder(options), "rep long, shingles binary")
    weights = groups.groupBy("group").agg(F.sum("n").alias("weight"))
    blocks = F.when(F.col("weight") > options.leaf_shingles, F.ceil(2 * F.col("weight") / options.leaf_shingles)).otherwise(1)
    keyed = _block_pairs(groups.join(weights, "group"), "group", blocks)
    dealt = keyed.join(encoded, "rep").select("key", "rep", "class", "met", F.lit(0).cast("long").alias("n"), "shingles")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps, classes, met, _, values in _by_key(batches):
            a, b = joining_links([np.frombuffer(v, np.uint64) for v in values], classes, met, options)
            yield pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], ["a", "b"])

    return saved(dealt.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(confirm, "a long, b long"))


def _encoder(options: PathOptions):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in words_of(batch.column(1), NO_SPACE):
                shingles = pa.array([s.tobytes() for s in shingle_sets(words, options.shingle)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), shingles], ["rep", "shingles"])

    return encode


def joining_links(sets: list[np.ndarray], classes: np.ndarray, met: np.ndarray, options: PathOptions) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked sets that join all classes which links join.

    Each set is compared with all later ones that are not yet of its class and that it has not met before.
    """
    sizes = np.array([len(s) for s in sets])
    ranks = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    root = np.unique(classes, return_inverse=True)[1]
    marked = np.zeros(len(ranks) + 1, bool)
    left, right = [], []
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (met[i + 1 :] != met[i]))
        others = others[(100 * np.minimum(sizes[others], sizes[i]) >= options.percent * np.maximum(sizes[others], sizes[i])) & (sizes[others] > 0)]
        if not len(others):
            continue
        own = ranks[bounds[i] : bounds[i + 1]]
        marked[own] = True
        lengths = sizes[others]
        starts = np.cumsum(lengths) - lengths
        both = np.add.reduceat(marked[ranks[np.repeat(bounds[others] - starts, lengths) + np.arange(lengths.sum())]], starts, dtype=np.int64)
        marked[own] = False
        for j in others[options.linked(both, sizes[i], lengths)]:
            if root[j] != root[i]:
                left.append(i)
                right.append(int(j))
                root[root == root[j]] = root[i]
    return np.array(left, np.int64), np.array(right, np.int64)
