"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import LETTERS_DIGITS, words_of
from clickloom.llm.training import Adam, held_out, sample_by, train, with_texts


@dataclass(frozen=True)
class ToxicityOptions:
    """``per_label``: rated documents of each label the machine is fitted on, at most, in two
    halves by label; ``rare``: terms of fewer of them are not used; ``association``: terms whose
    share of toxic documents is fewer standard deviations from that of all are used, but drawn
    to zero by one of ``pulls`` instead of ``shrink``, the one that suits documents left out best."""

    bits: int = 18
    factors: int = 4
    per_label: int = 12_000
    rare: int = 8
    association: float = 3.5
    epochs: int = 12
    rate: float = 0.02
    shrink: float = 2e-4
    pulls: tuple[float, ...] = (30.0, 3.0, 0.3, 2e-4)
    threshold: float = 0.3
    seed: int = 5


def score_toxicity(
    docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions(), id_column: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    A document is the set of its terms: runs of ASCII letters, digits and all
    beyond ASCII, A-Z lower-cased, hashed to ``2**bits`` places. The score is the
    logistic of a bias, a weight per term and the products of the factors of
    every two terms, so that terms can matter together that do not matter alone.
    Labels of documents that are not held out are learned from; null labels and
    labels other than 0 and 1 are not; a document rated twice counts twice.
    Null and empty texts have no terms and get the score of the bias. Without
    labels every score is that of an even prior. Columns of ``docs`` called like a
    new one are replaced.
    """
    rated = labels.select(F.col(id_column).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    rated = rated.where(~held_out("id") & F.col("id").isNotNull())
    chosen = sample_by(rated, "toxic", "id", options.per_label)
    # how many rated documents a chosen one of each label stands for
    weights = rated.groupBy("toxic").count().join(chosen.groupBy("toxic").agg(F.count("*").alias("n")), "toxic").select("toxic", (F.col("count") / F.col("n")).alias("weight"))
    rows = with_texts(docs, chosen.join(weights, "toxic"), id_column).select("id", "toxic", "weight", "text")
    model = train(_term_sets(rows, options), lambda data: fit(data, options))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows at most

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(pa.array(texts, pa.large_string()), shared.value, options))

    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*kept, held_out(id_column).alias("held_out"), score(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= options.threshold).cast("int"))


def _terms(column: pa.Array, options: ToxicityOptions, used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, terms): each term of a row once, for pieces of a column."""
    mask = np.uint64((1 << options.bits) - 1)
    for row, end, words in words_of(column, LETTERS_DIGITS):
        terms = (words.hashes() & mask).astype(np.int64)
        rows = words.rows
        if used is not None:
            keep = used[terms]
            terms, rows = terms[keep], rows[keep]
        pairs = np.unique((rows << options.bits) | terms)
        yield row, end, pairs >> options.bits, pairs & int(mask)


def _term_sets(rows: DataFrame, options: ToxicityOptions) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, at, terms in _terms(batch.column(3), options):
                offsets = np.searchsorted(at, np.arange(end - row + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(terms.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, end - row) for i in range(3)), lists], ["id", "toxic", "weight", "terms"]
                )

    return rows.mapInArrow(sets, f"id {rows.schema['id'].dataType.simpleString()}, toxic int, weight double, terms array<int>")


def fit(data: pd.DataFrame, options: ToxicityOptions) -> dict[str, np.ndarray]:
    """Bias, weights and factors by logistic loss; all terms that are not rare have them.

    A term that says nothing alone may do so in a pair, which no count of single
    terms shows. How much noise such terms add depends on the corpus: a fifth of
    the ids is left out to choose their pull, then all rows are fitted.
    """
    data = data.sort_values(["id", "toxic"], kind="stable")
    left_out = (pd.util.hash_array(data["id"].astype(str).to_numpy(object)) % 5 == 0) if len(data) else np.zeros(0, bool)
    losses = [_loss(data[left_out], _fit(data[~left_out], options, pull)) for pull in options.pulls]
    return _fit(data, options, options.pulls[int(np.argmin(losses))])


def _loss(data: pd.DataFrame, model: dict[str, np.ndarray]) -> float:
    """Weighted logistic loss of rated documents, 0 without any."""
    lists = [np.asarray(t, np.int64) for t in data["terms"]]
    lists = [t[model["used"][t]] for t in lists]
    terms = np.concatenate([np.zeros(0, np.int64), *lists])
    logit, _ = _logits(np.repeat(np.arange(len(lists)), [len(t) for t in lists]).astype(np.int64), terms, len(lists), model)
    sign = 1 - 2 * data["toxic"].to_numpy(np.float64)
    return float((data["weight"].to_numpy(np.float64) * np.logaddexp(0, sign * logit)).sum())


def _fit(data: pd.DataFrame, options: ToxicityOptions, pull: float) -> dict[str, np.ndarray]:
    """``fit`` of sorted rows with a known pull."""
    size = 1 << options.bits
    rng = np.random.default_rng(options.seed)
    lists = [np.asarray(t, np.int64) for t in data["terms"]] if len(data) else []
    flat = np.concatenate([np.zeros(0, np.int64), *lists])
    counts = np.bincount(flat, minlength=size)
    rated = np.repeat(data["toxic"].to_numpy(np.float64), [len(t) for t in lists]) if len(data) else np.zeros(0)
    common = data["toxic"].mean() if len(data) else 0.0
    expected, spread = counts * common, np.sqrt(counts * common * (1 - common))
    apart = np.abs(np.bincount(flat, rated, size) - expected) >= options.association * np.maximum(spread, 1e-9)
    used = counts >= options.rare
    shrink = np.where(apart[used], options.shrink, pull)
    number = np.cumsum(used) - 1
    active = int(used.sum())
    target = data["toxic"].to_numpy(np.float64) if len(data) else np.zeros(0)
    # the sample holds both labels alike; weights give them their shares back
    weight = data["weight"].to_numpy(np.float64) if len(data) else np.zeros(0)
    share = np.clip((weight * target).sum() / max(weight.sum(), 1e-9), 0.001, 0.999) if len(data) else 0.5
    weights = {
        "bias": np.array([np.log(share / (1 - share))]),
        "linear": np.zeros(max(1, active)),
        "factors": rng.normal(0, 0.01, (max(1, active), options.factors)),
    }
    kept = [number[t[used[t]]] for t in lists]
    weight = weight / weight.mean() if len(data) else weight
    adam = Adam(weights, options.rate)
    for epoch in range(options.epochs if active else 0):
        adam.rate = options.rate * (1 - epoch / options.epochs)
        order = rng.permutation(len(kept))
        for part in np.array_split(order, -(-len(order) // 256)):
            terms = np.concatenate([np.zeros(0, np.int64), *(kept[i] for i in part)])
            rows = np.repeat(np.arange(len(part)), [len(kept[i]) for i in part])
            logit, total = _logits(rows, terms, len(part), weights)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target[part]) * weight[part] / len(part)
            linear = np.bincount(terms, error[rows], active)
            back = error[rows, None] * (total[rows] - weights["factors"][terms])
            factors = np.stack([np.bincount(terms, back[:, k], active) for k in range(options.factors)], axis=1)
            adam.update({"bias": np.array([error.sum()]), "linear": linear, "factors": factors})
            # apart from the steps, which hide how large a gradient is
            weights["linear"] *= 1 - shrink * adam.rate
            weights["factors"] *= (1 - shrink * adam.rate)[:, None]
    full = {"bias": weights["bias"], "used": used, "linear": np.zeros(size, np.float32), "factors": np.zeros((size, options.factors), np.float32)}
    if active:
        full["linear"][used], full["factors"][used] = weights["linear"], weights["factors"]
    return full


def _logits(rows: np.ndarray, terms: np.ndarray, count: int, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Half of (sum of factors) squared less the sum of their squares is the sum over pairs."""
    factors = weights["factors"][terms]
    total = np.stack([np.bincount(rows, factors[:, k], count) for k in range(factors.shape[1])], axis=1)
    squares = np.bincount(rows, (factors**2).sum(axis=1), count)
    linear = np.bincount(rows, weights["linear"][terms], count)
    return weights["bias"][0] + linear + 0.5 * ((total**2).sum(axis=1) - squares), total


def scores(texts: pa.Array, model: dict[str, np.ndarray], options: ToxicityOptions) -> np.ndarray:
    found = np.zeros(len(texts))
    for row, end, at, terms in _terms(texts, options, model["used"]):
        logit, _ = _logits(at, terms, end - row, model)
        found[row:end] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return found
