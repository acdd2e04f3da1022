"""Language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.storage import set_aside
from clickloom.llm.text import buffers, pieces
from clickloom.llm.training import Adam, held_out, sample_by, train, with_texts

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageOptions:
    """``per_language``: documents of each language the network is fitted on, at most;
    ``windows_per_document``: windows of each of them, drawn from its whole text.
    ``least_score``: what ``keep_identified`` wants of a document."""

    window: int = 192
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    per_language: int = 600
    windows_per_document: int = 12
    epochs: int = 6
    rate: float = 0.01
    least_score: float = 0.3
    seed: int = 7


def identify(docs: DataFrame, options: LanguageOptions = LanguageOptions(), id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Fitted on ``text`` and non-null ``lang`` of the documents that are not held
    out; then every whole text is cut into windows of ``window`` bytes, the
    network gives each a probability per language, and the document gets their
    mean, weighted by letters. Null texts and texts without any letter are
    ``und`` with score 0, and so is everything if there is nothing to learn from.
    Repeated rows get the same answer. A column of ``docs`` that is called like
    one of the three new ones is replaced.
    """
    known = docs.select(F.col(id_column).alias("id"), F.col("lang").cast("string").alias("lang")).where(~held_out("id") & F.col("lang").isNotNull())
    chosen = with_texts(docs, sample_by(known, "lang", "id", options.per_language), id_column).where(_has_letter())
    model = train(chosen.select("id", F.lower("text").alias("text"), "lang"), lambda rows: fit(rows, options))
    return _apply(docs, model, options, id_column)


def keep_identified(docs: DataFrame, options: LanguageOptions = LanguageOptions(), id_column: str = "doc_id") -> DataFrame:
    """The documents in a language the network knows, with their own columns."""
    hidden, own = set_aside(docs, ("held_out", "lang_pred", "score"))
    found = identify(hidden, options, id_column)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= options.least_score)).select(*own)


def _has_letter():
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def _apply(docs: DataFrame, model: dict[str, np.ndarray], options: LanguageOptions, id_column: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    languages = model["languages"].tolist()

    @F.pandas_udf("struct<language:string, score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        mean = document_scores(pa.array(texts, pa.large_string()), shared.value, options)
        best = mean.argmax(axis=1)
        return pd.DataFrame({"language": np.array(languages, object)[best], "score": mean.max(axis=1).clip(0, 1)})

    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    flagged = docs.select(*kept, held_out(id_column).alias("held_out"), _has_letter().alias("_letter"))
    if not languages:
        return flagged.select(*kept, "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = flagged.withColumn("_found", predict(F.lower(F.col("text").cast("string"))))
    return found.select(
        *kept,
        "held_out",
        F.when(F.col("_letter"), F.col("_found.language")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letter"), F.col("_found.score")).otherwise(0.0).alias("score"),
    )


def fit(rows: pd.DataFrame, options: LanguageOptions) -> dict[str, np.ndarray]:
    """Weights from lower-case texts and their languages."""
    rows = rows.sort_values("id", kind="stable")
    languages = sorted(rows["lang"].unique())
    rng = np.random.default_rng(options.seed)
    windows, target = [], []
    for text, language in zip(rows["text"], rows["lang"]):
        data = np.frombuffer(text.encode(), np.uint8)
        count = min(options.windows_per_document, -(-len(data) // options.window))
        for at in rng.integers(0, max(1, len(data) - options.window + 1), count):
            # short pieces too, as short documents have no more
            size = options.window if rng.random() < 0.6 else int(rng.integers(8, options.window + 1))
            windows.append(np.pad(data[at : at + size][: options.window], (0, max(0, options.window - min(size, len(data) - at)))))
            target.append(languages.index(language))
    weights = {
        "embedding": rng.normal(0, 0.5, (256, options.embedding)).astype(np.float32),
        "filters": rng.normal(0, 0.2, (max(options.widths) * options.embedding, options.filters * len(options.widths))).astype(np.float32),
        "bias": np.zeros(options.filters * len(options.widths), np.float32),
        "out": rng.normal(0, 0.2, (options.filters * len(options.widths), max(1, len(languages)))).astype(np.float32),
        "out_bias": np.zeros(max(1, len(languages)), np.float32),
    }
    used = _used_weights(options)
    weights["filters"] *= used
    weights["embedding"][0] = 0
    if windows:
        windows, target = np.stack(windows), np.array(target)
        adam = Adam(weights, options.rate)
        for epoch in range(options.epochs):
            adam.rate = options.rate * (1 - epoch / options.epochs)
            order = rng.permutation(len(windows))
            for part in np.array_split(order, -(-len(order) // 64)):
                gradients = _gradients(windows[part], target[part], weights, options)
                gradients["filters"] *= used
                adam.update(gradients)
    return weights | {"languages": np.array(languages, dtype=str)}


def _used_weights(options: LanguageOptions) -> np.ndarray:
    """1 where a filter of its width has weights; all filters are stored at the largest width."""
    used = np.zeros((max(options.widths), options.embedding, len(options.widths), options.filters), np.float32)
    for i, width in enumerate(options.widths):
        used[:width, :, i] = 1
    return used.reshape(max(options.widths) * options.embedding, -1)


def _convolved(windows: np.ndarray, weights: dict[str, np.ndarray], options: LanguageOptions):
    width = max(options.widths)
    embedded = weights["embedding"][windows]
    positions = windows.shape[1] - width + 1
    columns = np.concatenate([embedded[:, i : i + positions] for i in range(width)], axis=2)
    return columns, columns.reshape(-1, columns.shape[2]) @ weights["filters"]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def window_probabilities(windows: np.ndarray, weights: dict[str, np.ndarray], options: LanguageOptions) -> np.ndarray:
    _, convolved = _convolved(windows, weights, options)
    pooled = convolved.reshape(len(windows), -1, convolved.shape[1]).max(axis=1) + weights["bias"]
    return _softmax(np.maximum(pooled, 0) @ weights["out"] + weights["out_bias"])


def _gradients(windows: np.ndarray, target: np.ndarray, weights: dict[str, np.ndarray], options: LanguageOptions) -> dict:
    count = len(windows)
    columns, convolved = _convolved(windows, weights, options)
    convolved = convolved.reshape(count, -1, convolved.shape[1])
    at = convolved.argmax(axis=1)
    pooled = np.take_along_axis(convolved, at[:, None], axis=1)[:, 0] + weights["bias"]
    active = np.maximum(pooled, 0)
    error = _softmax(active @ weights["out"] + weights["out_bias"])
    error[np.arange(count), target] -= 1
    error /= count
    back = (error @ weights["out"].T) * (pooled > 0)
    # only the position that won the pooling passes anything back
    chosen = np.take_along_axis(columns[:, :, :, None], at[:, None, None, :], axis=1)[:, 0]
    filters = np.einsum("ncf,nf->cf", chosen, back)
    to_columns = (back[:, None, :] * weights["filters"][None]).reshape(count, max(options.widths), options.embedding, -1)
    embedding = np.zeros_like(weights["embedding"])
    for i in range(max(options.widths)):
        np.add.at(embedding, np.take_along_axis(windows, at + i, axis=1), to_columns[:, i].transpose(0, 2, 1))
    embedding[0] = 0  # padding
    return {"embedding": embedding, "filters": filters, "bias": back.sum(axis=0), "out": active.T @ error, "out_bias": error.sum(axis=0)}


def document_scores(texts: pa.Array, weights: dict[str, np.ndarray], options: LanguageOptions, at_once: int = 128) -> np.ndarray:
    """Mean probabilities of each whole text; zeros for an empty one."""
    data, offsets = buffers(texts)
    total = np.zeros((len(texts), weights["out"].shape[1]))
    size = options.window
    for row, end in pieces(offsets):
        bounds = offsets[row : end + 1]
        counts = -(-np.diff(bounds) // size)
        owner = np.repeat(np.arange(row, end), counts)
        before = np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        starts = np.repeat(bounds[:-1], counts) + size * (np.arange(len(owner)) - before)
        ends = offsets[owner + 1]
        for i in range(0, len(owner), at_once):
            part = slice(i, i + at_once)
            at = starts[part, None] + np.arange(size)
            windows = np.where(at < ends[part, None], data[np.minimum(at, len(data) - 1)], 0)
            letters = ((windows >= 97) & (windows <= 122) | (windows >= 128)).sum(axis=1)
            weight = letters + 0.01
            np.add.at(total, owner[part], window_probabilities(windows, weights, options) * weight[:, None])
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
