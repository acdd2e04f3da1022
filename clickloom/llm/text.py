"""Words of a text column, found on whole Arrow buffers.

Texts are UTF-8; a class of bytes decides what a word is, and every byte from
0x80 on belongs to a word, so that no character is ever split. Only A-Z are
lower-cased. Work goes through pieces of about ``PIECE`` bytes (a longer text is
a piece of its own), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NO_SPACE = np.ones(256, dtype=bool)
NO_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LETTERS_DIGITS = np.zeros(256, dtype=bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_POWERS = np.ones(64, dtype=np.uint64)


@dataclass
class Words:
    """Words of consecutive rows: ``first[r]:first[r + 1]`` are the words of row r.

    ``raw`` has their bytes, ``text`` the same with A-Z lower-cased.
    """

    raw: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit value for each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        inside = np.arange(lengths.sum()) - np.repeat(before, lengths)
        values = (self.text[np.repeat(self.starts, lengths) + inside].astype(np.uint64) + np.uint64(1)) * powers(
            lengths.max()
        )[inside]
        return mix(np.add.reduceat(values, before) + lengths.astype(np.uint64))


def powers(count: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < count:
        _POWERS = np.ones(2 * int(count), dtype=np.uint64)
    if _POWERS[1] == 1:
        _POWERS[1:] = np.multiply.accumulate(np.full(len(_POWERS) - 1, 0x9E3779B97F4A7C15, np.uint64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, of one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, row + 20_000, rows)
        yield row, end
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """The words of the rows between ``offsets``."""
    low = offsets[0]
    raw = data[low : offsets[-1]]
    bounds = offsets - low
    inside = word_bytes[raw]
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside.copy()
    before[bounds[bounds < len(raw)]] = False
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside.copy()
    after[bounds[bounds > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(raw, LOWER[raw], starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds))


def words_of(column: pa.Array, word_bytes: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for pieces of a column."""
    data, offsets = buffers(column)
    for row, end in pieces(offsets, limit):
        yield row, end, find_words(data, offsets[row : end + 1], word_bytes)


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One value for a sequence of words, which depends on their order and number."""
    value = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + column)
    return value


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row.

    A row of fewer words has its whole sequence as one shingle, a row without
    words the empty set.
    """
    hashes = words.hashes()
    runs = len(hashes) - size + 1
    shingles = fold([hashes[i : i + runs] for i in range(size)]) if runs > 0 else np.zeros(0, np.uint64)
    for start, count in zip(words.first[:-1], words.counts):
        if count >= size:
            found = np.sort(shingles[start : start + count - size + 1])
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif count:
            found = fold([hashes[start + i : start + i + 1] for i in range(count)])
        else:
            found = np.zeros(0, np.uint64)
        yield found
