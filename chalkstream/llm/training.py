"""Fitting a small model in one task on a bounded sample."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import params


def fold_of(doc_id: Column, folds: int) -> Column:
    """The document's fold: a checksum of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sampled(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of ``doc_id``; the same ones in every run."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def trainable(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) <= params.TRAIN_CHARS


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: of several texts the one whose hash is least."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


class _Fit:
    def __init__(self, fit: Callable[[pa.Table], object]):
        self.fit = fit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        model = self.fit(pa.Table.from_batches(rows)) if any(map(len, rows)) else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object], order: list[str]):
    """What ``fit`` makes of all rows of a bounded sample, in the given order: plain values and arrays, or None."""
    one = rows.repartition(1).sortWithinPartitions(*order)
    made = one.mapInArrow(_Fit(fit), "model binary").first()
    return pickle.loads(made["model"]) if made else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.w, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.w[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.w[k] -= self.rate * m / (np.sqrt(v) + 1e-8)
