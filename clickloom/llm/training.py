"""Labelled samples of bounded size, and training in one task."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.storage import bound_batches, saved

HELD_OUT = 2
BROADCAST_ROWS = 200_000


def held_out(id_column: str) -> Column:
    """True for the quarter of ids that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def sample_by(rows: DataFrame, label: str, id_column: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, all if there are fewer, chosen by the hash of the id.

    The choice does not depend on how the rows are partitioned. ``rows`` should
    be narrow: they are shuffled by label.
    """
    share = rows.groupBy(label).count().select(F.col(label), (F.lit(per_label) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    return rows.join(share, label).where(draw < F.col("share")).drop("share")


def with_texts(docs: DataFrame, chosen: DataFrame, id_column: str) -> DataFrame:
    """``chosen(id, ...)`` with the ``text`` of their documents, null as empty.

    A sample of up to ``BROADCAST_ROWS`` rows is broadcast, so that texts are not
    shuffled; a larger one is joined by Spark's own choice.
    """
    bound_batches(docs.sparkSession)
    chosen = saved(chosen)
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, "id")


def train(rows: DataFrame, fit: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that ``fit`` makes of a bounded sample, in one task; only they reach the driver."""

    columns = rows.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        data = pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=columns)
        out = io.BytesIO()
        np.savez(out, **fit(data))
        yield pd.DataFrame({"model": [out.getvalue()]})

    models = rows.repartition(1).mapInPandas(task, "model binary").collect()
    if not models:  # no task runs for no rows
        return fit(pd.DataFrame(columns=columns))
    with np.load(io.BytesIO(models[0]["model"]), allow_pickle=False) as found:
        return dict(found)


class Adam:
    """Adam steps on a dict of arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.weights[k] -= (rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(self.weights[k].dtype)
