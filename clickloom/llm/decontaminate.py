"""Benchmark decontamination by suffix arrays over shards of training text.

A shard is a piece of the documents that one task reads. Its words are numbered
by the vocabulary of the benchmark; a word that no benchmark item has is 0 and
ends every match. The suffix array orders the positions of benchmark words by
what follows them, as deep as the longest item, by doubling. Every suffix of
every benchmark item is then binary-searched in it: the neighbours of its place
give its longest verbatim match. Windows at which such a match is long enough occur
in the shard; the range that begins with one gives all its places. The text at
these places is searched in the suffix array of the benchmark, which gives the
longest match of each document, its item and where it is.

The benchmark is cut into blocks of at most ``block_words`` words. Each is
broadcast and makes one pass over the documents in the same stage; all blocks are
broadcast before the first action, so the whole benchmark has to fit on an
executor. Documents are never shuffled. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.storage import bound_batches, set_aside
from clickloom.llm.text import LETTERS_DIGITS, buffers, find_words, pieces


FINDINGS = ("n_words", "spans", "items", "longest")


@dataclass(frozen=True)
class DecontaminationOptions:
    """``window``: words that have to match; an item of fewer, but not none, is one window.
    ``block_words``: benchmark words in a broadcast. ``shard_bytes``: text in a suffix array;
    a longer document is a shard of its own."""

    window: int = 10
    block_words: int = 200_000
    shard_bytes: int = 2 << 20


@dataclass
class Block:
    """Benchmark items as word numbers, one after the other, each followed by a 0."""

    hashes: np.ndarray
    numbers: np.ndarray
    words: np.ndarray
    item: np.ndarray
    left: np.ndarray
    names: list[str]
    windows: np.ndarray
    sizes: np.ndarray
    owners: list[list[str]]
    suffixes: np.ndarray
    window_of: np.ndarray
    order: np.ndarray

    @property
    def depth(self) -> int:
        """Words of the longest item."""
        return int(self.left.max(initial=1))

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and word of positions."""
        first = np.concatenate([[0], np.flatnonzero(self.words == 0) + 1])
        return self.item[at], at - first[self.item[at]]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()
) -> DataFrame:
    """``docs`` with ``n_words``, the ``spans`` of words inside found windows, the ``items`` found and the ``longest`` match.

    A-Z are lower-cased; words are runs of ASCII letters, digits and everything
    beyond ASCII. Spans are disjoint, in order and end exclusive; items are
    sorted. ``longest`` (length, word, item, item_word) is the longest verbatim match
    that begins with a window: its words, where it begins in the document, and
    an item that has it with the place there; of equal ones the first in the
    document; NULL without a finding. Null and empty texts have no words; items without words or
    without id match nothing; a repeated item counts once. Columns of ``docs``
    called like a new one are replaced.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in FINDINGS]
    found = docs.select(
        *kept,
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        F.lit(None).cast("struct<length:bigint,word:bigint,item:string,item_word:bigint>").alias("longest"),
    )
    context = docs.sparkSession.sparkContext
    for block in _blocks(benchmark, options):
        found = found.mapInArrow(_searcher(context.broadcast(block), found.columns.index("text"), options), found.schema)
    return found


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions(), id_column: str = "doc_id"
) -> DataFrame:
    """(item_id, item_word, length, doc_id, doc_word): the longest verbatim match of every benchmark suffix.

    ``item_word`` is where the suffix begins, ``doc_word`` where its match does,
    both counted in words from 0. Of equal matches, the smallest document and
    place that any shard reports. Suffixes without a common word have no row.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    bound_batches(docs.sparkSession)
    best = None
    for block in _blocks(benchmark, options):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = texts.mapInArrow(_longest_in_shards(shared, options), "item_id string, item_word long, length long, doc_id long, doc_word long")
        best = found if best is None else best.unionByName(found)
    order = F.struct(-F.col("length"), "doc_id", "doc_word")
    return best.groupBy("item_id", "item_word").agg(F.min(order).alias("m")).select(
        "item_id", "item_word", (-F.col("m.col1")).alias("length"), "m.doc_id", "m.doc_word"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    hidden, own = set_aside(docs, FINDINGS)
    return find_contamination(hidden, benchmark, options).where(F.size("items") == 0).select(*own)


# --- benchmark ----------------------------------------------------------------------------


def _blocks(benchmark: DataFrame, options: DecontaminationOptions) -> Iterator[Block]:
    """Blocks of items, in the order of their ids. One block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    items = items.where("id is not null and text is not null").distinct().orderBy("id", "text")
    names, hashes, size, any_ = [], [], 0, False
    for row in items.toLocalIterator():
        data, offsets = buffers(pa.array([row["text"]], pa.large_string()))
        words = find_words(data, offsets, LETTERS_DIGITS).hashes()
        if not len(words):
            continue
        if size and size + len(words) > options.block_words:
            yield _block(names, hashes, options)
            names, hashes, size, any_ = [], [], 0, True
        names.append(row["id"])
        hashes.append(words)
        size += len(words)
    if names or not any_:
        yield _block(names, hashes, options)


def _block(names: list[str], hashes: list[np.ndarray], options: DecontaminationOptions) -> Block:
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    parts, item, left, windows, sizes, owner = [], [], [], [], [], []
    at = 0
    for i, words in enumerate(hashes):
        parts += [np.searchsorted(known, words) + 1, [0]]
        item.append(np.full(len(words) + 1, i))
        left.append(np.arange(len(words), -1, -1))
        size = min(options.window, len(words))
        starts = np.arange(at, at + len(words) - size + 1)
        windows.append(starts)
        sizes.append(np.full(len(starts), size))
        owner.append(np.full(len(starts), i))
        at += len(words) + 1
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
    words, windows, sizes, owner = flat(parts), flat(windows), flat(sizes), flat(owner)
    # each distinct window is searched once
    keys: dict[bytes, int] = {}
    first, owners = [], []
    window_of = np.full(len(words), -1)
    for start, size, i in zip(windows, sizes, owner):
        window_of[start] = k = keys.setdefault(words[start : start + size].tobytes(), len(keys))
        if k == len(owners):
            first.append((start, size))
            owners.append([])
        if names[i] not in owners[k]:
            owners[k].append(names[i])
    first = np.array(first, np.int64).reshape(-1, 2)
    left = flat(left)
    suffixes, order = np.flatnonzero(left > 0), suffix_array(words, int(left.max(initial=1)))
    return Block(
        known, np.arange(1, len(known) + 1), words, flat(item), left, names, first[:, 0], first[:, 1], owners,
        suffixes, window_of[suffixes], order,
    )


# --- shards ----------------------------------------------------------------------------------


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of words other than 0 in order of what follows, ``depth`` words deep.

    What lies beyond a 0 does not count.
    """
    at = np.flatnonzero(words)
    rank = np.zeros(len(words) + 1, np.int64)
    rank[:-1] = words
    step, distinct, order = 1, 0, at[np.argsort(words[at], kind="stable")]
    while step < depth and len(order):
        key = rank[at] * (rank.max() + 1) + rank[np.minimum(at + step, len(words))]
        by = np.argsort(key, kind="stable")
        order, key = at[by], key[by]
        new = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
        rank[order] = new
        if new[-1] == distinct:
            break
        step, distinct = 2 * step, new[-1]
    return order


def _compare(words: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words of text suffixes and query suffixes, and the sign of text against query there.

    A query that ends first counts as equal; 0 in the text is below everything.
    """
    common = np.zeros(len(at), np.int64)
    sign = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(limit > 0)
    while len(open_):
        t = words[at[open_] + common[open_]]
        q = query[start[open_] + common[open_]]
        sign[open_] = np.sign(t - q)
        open_ = open_[t == q]
        common[open_] += 1
        open_ = open_[common[open_] < limit[open_]]
    return common, sign


def _bound(shard: "Shard | Block", query, start, limit, upper: bool) -> np.ndarray:
    """Where each query suffix belongs in the suffix array, before or after those it begins."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(shard.order))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        _, sign = _compare(shard.words, shard.order[middle], query, start[open_], limit[open_])
        below = sign <= 0 if upper else sign < 0
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
    return low


def _nearest(shard: "Shard | Block", query, start, limit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """On either side of its place in the suffix array, the common words of each query suffix and where they are."""
    at = _bound(shard, query, start, limit, False)
    for side in (at - 1, at):
        inside = (side >= 0) & (side < len(shard.order))
        text = shard.order[np.clip(side, 0, len(shard.order) - 1)]
        common, _ = _compare(shard.words, text, query, start, np.where(inside, limit, 0))
        yield common, text


@dataclass
class Shard:
    """Documents as benchmark word numbers, each followed by a 0, and their suffix array."""

    counts: np.ndarray
    begins: np.ndarray
    words: np.ndarray
    order: np.ndarray

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word of positions."""
        doc = np.searchsorted(self.begins, at, "right") - 1
        return doc, at - self.begins[doc]


def _shard(data: np.ndarray, offsets: np.ndarray, block: Block, depth: int) -> Shard:
    found = find_words(data, offsets, LETTERS_DIGITS)
    counts, hashes = found.counts, found.hashes()
    numbers = np.zeros(len(hashes), np.int64)
    if len(block.hashes) and len(hashes):
        place = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
        numbers = np.where(block.hashes[place] == hashes, place + 1, 0)
    shift = np.arange(len(counts))
    words = np.zeros(len(hashes) + len(counts) + 1, np.int64)
    words[np.arange(len(hashes)) + np.repeat(shift, counts)] = numbers
    return Shard(counts, found.first[:-1] + shift, words, suffix_array(words, depth))


def _searcher(shared, text_index: int, options: DecontaminationOptions):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(text_index).cast(pa.string()))
            for row, end in pieces(offsets, options.shard_bytes):
                shard = _shard(data, offsets[row : end + 1], block, block.depth)
                yield _with_findings(batch.slice(row, end - row), shard, block)

    return search


def _with_findings(rows: pa.RecordBatch, shard: Shard, block: Block) -> pa.RecordBatch:
    hit = np.zeros(len(shard.words) + 1, np.int64)
    items: dict[int, set[str]] = {}
    longest: dict[int, dict] = {}
    found = _found_windows(shard, block)
    if len(found):
        low = _bound(shard, block.words, block.windows[found], block.sizes[found], False)
        high = _bound(shard, block.words, block.windows[found], block.sizes[found], True)
        times = high - low
        which = np.repeat(found, times)
        places = shard.order[np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
        np.add.at(hit, places, 1)
        np.add.at(hit, places + block.sizes[which], -1)
        doc, _ = shard.place(places)
        pairs = np.unique(doc * len(block.windows) + which)
        for d, w in zip((pairs // len(block.windows)).tolist(), (pairs % len(block.windows)).tolist()):
            items.setdefault(d, set()).update(block.owners[w])
        longest = _longest_of_documents(shard, block, np.unique(places))
    inside = (np.cumsum(hit[:-1]) > 0).astype(np.int8)
    edges = np.diff(np.concatenate(([0], inside, [0])))
    doc, starts = shard.place(np.flatnonzero(edges == 1))
    ends = np.flatnonzero(edges == -1) - shard.begins[doc]
    spans: dict[int, list[tuple[int, int]]] = {}
    for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist()):
        spans.setdefault(d, []).append((s, e))

    schema, columns = rows.schema, {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
    old_spans, old_items, old_longest = (columns[c].to_pylist() for c in ("spans", "items", "longest"))
    columns |= {
        "n_words": pa.array(shard.counts, pa.int64()),
        "spans": pa.array([_merged(x, spans.get(d, [])) for d, x in enumerate(old_spans)], schema.field("spans").type),
        "items": pa.array([sorted({*x, *items.get(d, ())}) for d, x in enumerate(old_items)], schema.field("items").type),
        "longest": pa.array([_longer(x, longest.get(d)) for d, x in enumerate(old_longest)], schema.field("longest").type),
    }
    return pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)


def _found_windows(shard: Shard, block: Block) -> np.ndarray:
    """Windows that occur: every suffix is searched, and the match of those that begin with one is as long."""
    if not len(shard.order) or not len(block.suffixes):
        return np.zeros(0, np.int64)
    matched = np.zeros(len(block.suffixes), np.int64)
    for common, _ in _nearest(shard, block.words, block.suffixes, block.left[block.suffixes]):
        matched = np.maximum(matched, common)
    begun = np.flatnonzero(block.window_of >= 0)
    windows = block.window_of[begun]
    return np.unique(windows[matched[begun] >= block.sizes[windows]])


def _longest_of_documents(shard: Shard, block: Block, places: np.ndarray) -> dict[int, dict]:
    """The longest match that begins at one of the ``places``, by document."""
    ends = np.flatnonzero(shard.words == 0)
    limit = np.minimum(ends[np.searchsorted(ends, places)] - places, block.depth)
    length, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for common, text in _nearest(block, shard.words, places, limit):
        better = common > length
        length, where = np.where(better, common, length), np.where(better, text, where)
    doc, word = shard.place(places)
    best = np.lexsort((word, -length, doc))
    best = best[np.unique(doc[best], return_index=True)[1]]
    item, item_word = block.place(where[best])
    values = (doc[best], length[best], word[best], item, item_word)
    return {
        d: {"length": n, "word": w, "item": block.names[i], "item_word": iw}
        for d, n, w, i, iw in zip(*(v.tolist() for v in values))
    }


def _longer(a: dict | None, b: dict | None) -> dict | None:
    """The longer match, the first in the document among equal ones; ``a`` if both are the same."""
    found = [m for m in (a, b) if m]
    return min(found, key=lambda m: (-m["length"], m["word"]), default=None)


def _longest_in_shards(shared, options: DecontaminationOptions):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        starts, limit = block.suffixes, block.left[block.suffixes]
        item, word = block.place(starts) if len(starts) else (starts, starts)
        names = np.array(block.names, object)[item] if len(starts) else np.zeros(0, object)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            for row, end in pieces(offsets, options.shard_bytes):
                shard = _shard(data, offsets[row : end + 1], block, block.depth)
                if not len(shard.order) or not len(starts):
                    continue
                for common, text in _nearest(shard, block.words, starts, limit):
                    ok = common > 0
                    doc, place = shard.place(text[ok])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[ok], pa.string()), pa.array(word[ok]), pa.array(common[ok]), pa.array(ids[row + doc]), pa.array(place)],
                        ["item_id", "item_word", "length", "doc_id", "doc_word"],
                    )

    return search


def _merged(a: list[dict], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for s, e in sorted([(x["start"], x["end"]) for x in a] + b):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return [{"start": s, "end": e} for s, e in spans]
