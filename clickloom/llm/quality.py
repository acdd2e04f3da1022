"""Quality by ordinal regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import NO_SPACE, Words, words_of
from clickloom.llm.training import Adam, held_out, sample_by, train, with_texts

#: Bytes as shapes: 0 space, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 a control, then each punctuation mark.
SHAPES = np.full(256, 5, np.int64)
SHAPES[[0x20, *range(0x09, 0x0E)]] = 0
SHAPES[0x61:0x7B], SHAPES[0x41:0x5B], SHAPES[0x30:0x3A], SHAPES[0x80:] = 1, 2, 3, 4
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
SHAPES[_MARKS] = 6 + np.arange(len(_MARKS))
SHAPE_COUNT = 6 + len(_MARKS)
#: Word number by steps of doubling, and how few of the words are different, in tenths.
LENGTHS, REPEATS = 24, 11


@dataclass(frozen=True)
class QualityOptions:
    """``per_grade``: rated documents of each grade the model is fitted on, at most;
    ``rare``: words of fewer of them have no weight. ``select``: tail probability from which on a
    document is selected; the tail begins at grade number ``tail_grade`` (the best one, if None)."""

    bits: int = 16
    per_grade: int = 4_000
    rare: int = 8
    epochs: int = 15
    rate: float = 0.02
    shrink: float = 1e-3
    tail_grade: int | None = None
    select: float = 0.5
    seed: int = 3


def rate_quality(
    docs: DataFrame,
    ratings: DataFrame,
    options: QualityOptions = QualityOptions(),
    id_column: str = "doc_id",
    grade_column: str = "quality",
) -> DataFrame:
    """``docs`` with ``held_out``, ``grade`` (expected), ``tail`` (probability) and ``selected``.

    Grades are the distinct non-null ratings in order, any number of them. One
    set of weights over hashed words, pairs of neighbouring byte shapes, length
    and repetition gives a document one value; P(grade > j) is the logistic of
    that value less the j-th threshold, and thresholds are kept in order.
    ``grade`` is the expected grade, ``tail`` the probability of ``tail_grade`` or
    better, ``selected`` whether it reaches ``select``. Learned from documents
    that are not held out; a document rated twice counts twice. Null and
    empty texts have no features. Without ratings all three are null. Columns of
    ``docs`` called like a new one are replaced.
    """
    rated = ratings.select(F.col(id_column).alias("id"), F.col(grade_column).cast("double").alias("grade")).where("grade is not null and id is not null")
    rated = rated.where(~held_out("id"))
    rows = with_texts(docs, sample_by(rated, "grade", "id", options.per_grade), id_column).select("id", "grade", "text")
    model = train(_feature_rows(rows, options), lambda data: fit(data, options))
    kept = [c for c in docs.columns if c not in ("held_out", "grade", "tail", "selected")]
    if not len(model["grades"]):
        none = F.lit(None).cast("double")
        return docs.select(*kept, held_out(id_column).alias("held_out"), none.alias("grade"), none.alias("tail"), F.lit(None).cast("boolean").alias("selected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights and a few more

    @F.pandas_udf("struct<grade:double, tail:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        grade, tail = predictions(pa.array(texts, pa.large_string()), shared.value, options)
        return pd.DataFrame({"grade": grade, "tail": tail})

    found = docs.select(*kept, held_out(id_column).alias("held_out"), predict(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_found"))
    return found.select(*kept, "held_out", "_found.grade", "_found.tail", (F.col("_found.tail") >= options.select).alias("selected"))


def _features(column: pa.Array, options: QualityOptions, used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, places, values) for pieces of a column, sorted by row."""
    for row, end, words in words_of(column, NO_SPACE):
        places, rows, values = [], [], []
        count = end - row
        hashed = (words.hashes() & np.uint64((1 << options.bits) - 1)).astype(np.int64)
        distinct, times = np.unique((words.rows << options.bits) | hashed, return_counts=True)
        at, place = distinct >> options.bits, distinct & ((1 << options.bits) - 1)
        numbers = words.counts
        different = np.bincount(at, minlength=count)
        keep = used[place] if used is not None else slice(None)
        rows.append(at[keep])
        places.append(place[keep])
        values.append((np.log1p(times) / np.sqrt(np.maximum(1, numbers[at])))[keep])
        base = 1 << options.bits
        for r, p, v in _shape_pairs(words, count):
            rows.append(r)
            places.append(base + p)
            values.append(v)
        base += SHAPE_COUNT**2
        rows += [np.arange(count), np.arange(count)]
        places += [base + np.minimum(LENGTHS - 1, np.log2(numbers + 1).astype(np.int64)), base + LENGTHS + (10 * different // np.maximum(1, numbers))]
        values += [np.ones(count), np.ones(count)]
        order = np.argsort(np.concatenate(rows), kind="stable")
        yield row, end, np.concatenate(rows)[order], np.concatenate(places)[order], np.concatenate(values)[order]


def _shape_pairs(words: Words, count: int):
    """Shares of neighbouring byte shapes inside words."""
    if not len(words.text):
        return
    owner = np.full(len(words.text), -1)
    lengths = words.ends - words.starts
    inside = np.repeat(words.starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    owner[inside] = np.repeat(words.rows, lengths)
    shape = SHAPES[words.raw]
    both = (owner[:-1] == owner[1:]) & (owner[:-1] >= 0)
    pairs, times = np.unique(owner[:-1][both] * SHAPE_COUNT**2 + shape[:-1][both] * SHAPE_COUNT + shape[1:][both], return_counts=True)
    rows = pairs // SHAPE_COUNT**2
    total = np.bincount(rows, times, count)
    yield rows, pairs % SHAPE_COUNT**2, np.sqrt(times / total[rows])


def _feature_rows(rows: DataFrame, options: QualityOptions) -> DataFrame:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, at, places, values in _features(batch.column(2), options):
                offsets = pa.array(np.searchsorted(at, np.arange(end - row + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (places.astype(np.int32), values.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, end - row) for i in range(2)), *lists], ["id", "grade", "places", "shares"])

    return rows.mapInArrow(features, f"id {rows.schema['id'].dataType.simpleString()}, grade double, places array<int>, shares array<float>")


def fit(data: pd.DataFrame, options: QualityOptions) -> dict[str, np.ndarray]:
    """Shared weights and ordered thresholds by the cumulative logistic likelihood."""
    rng = np.random.default_rng(options.seed)
    size = (1 << options.bits) + SHAPE_COUNT**2 + LENGTHS + REPEATS
    data = data.sort_values(["id", "grade"], kind="stable")
    grades = np.unique(data["grade"].to_numpy(np.float64)) if len(data) else np.zeros(0)
    places = [np.asarray(x, np.int64) for x in data["places"]]
    values = [np.asarray(x, np.float64) for x in data["shares"]]
    counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *places]), minlength=size)
    used = counts >= options.rare
    cuts = max(0, len(grades) - 1)
    # thresholds are a first one and positive steps, so they stay in order
    weights = {"weights": np.zeros(size), "first": np.zeros(1), "steps": np.zeros(max(0, cuts - 1))}
    target = np.searchsorted(grades, data["grade"].to_numpy(np.float64)) if len(data) else np.zeros(0, np.int64)
    if cuts:
        above = np.array([(target > j).mean() for j in range(cuts)]).clip(0.01, 0.99)
        start = -np.log(above / (1 - above))
        weights["first"][:] = start[0]
        weights["steps"][:] = np.log(np.maximum(np.diff(start), 0.05))
    adam = Adam(weights, options.rate)
    for epoch in range(options.epochs if cuts else 0):
        adam.rate = options.rate * (1 - epoch / options.epochs)
        order = rng.permutation(len(places))
        for part in np.array_split(order, -(-len(order) // 128)):
            place = np.concatenate([places[i] for i in part])
            value = np.concatenate([values[i] for i in part]) * used[place]
            rows = np.repeat(np.arange(len(part)), [len(places[i]) for i in part])
            x = np.bincount(rows, value * weights["weights"][place], len(part))
            down, up = _tail_slopes(x, target[part], thresholds(weights))
            slope = (down + up).sum(axis=1) / len(part)
            by_cut = -(down + up).sum(axis=0) / len(part)
            gradient = np.bincount(place, value * slope[rows], size) + options.shrink * weights["weights"]
            steps = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(weights["steps"])
            adam.update({"weights": gradient, "first": np.array([by_cut.sum()]), "steps": steps})
    return {"weights": weights["weights"] * used, "used": used[: 1 << options.bits], "thresholds": thresholds(weights)[:cuts], "grades": grades}


def thresholds(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights["first"], weights["first"] + np.cumsum(np.exp(weights["steps"]))])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tail_slopes(x: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the negative log likelihood by value less threshold, at the cut below and above the grade."""
    tails = _logistic(x[:, None] - cuts)
    padded = np.concatenate([np.ones((len(x), 1)), tails, np.zeros((len(x), 1))], axis=1)
    own = np.arange(len(x))
    chance = np.maximum(padded[own, grade] - padded[own, grade + 1], 1e-9)
    bend = tails * (1 - tails) / chance[:, None]
    number = np.arange(len(cuts))
    return -bend * (number == grade[:, None] - 1), bend * (number == grade[:, None])


def predictions(texts: pa.Array, model: dict[str, np.ndarray], options: QualityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Expected grades and tail probabilities."""
    x = np.zeros(len(texts))
    for row, end, at, places, values in _features(texts, options, model["used"]):
        x[row:end] = np.bincount(at, values * model["weights"][places], end - row)
    tails = _logistic(x[:, None] - model["thresholds"])
    grades = model["grades"]
    grade = grades[0] + tails @ np.diff(grades)
    number = len(grades) - 1 if options.tail_grade is None else options.tail_grade
    return grade, tails[:, number - 1] if number > 0 else np.ones(len(texts))
