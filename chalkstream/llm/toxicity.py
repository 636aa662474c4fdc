"""Toxicity scores by non-negative positive-unlabelled learning.

Only some toxic documents are known; all other text is unlabelled and holds toxic documents too. With the share
``prior`` of toxic documents among all, the risk of a classifier g under the sigmoid loss l is

    prior E_P l(g) + max(0, E_U l(-g) - prior E_P l(-g))

whose second term stands for the clean documents. Where it falls below zero the model has begun to
learn the positives by heart, and the step goes the other way. g is linear in the rates of words and of
beginnings of words (languages that inflect and compound): the hashed ones whose rates differ most between the
positives and the unlabelled sample. The prior is the toxic share of the labels outside the held-out fold.

The model is fitted in one task on bounded samples (``TOXIC_POSITIVES``, ``TOXIC_UNLABELLED`` documents of at most
``TRAIN_CHARS``), none from the held-out fold; the unlabelled sample is drawn from all documents, known positives too, as
the risk presumes. All documents are scored on all their words. Only the ``TOXIC_FEATURES`` strongest words of the sample
carry weight: with all words of three or more positives the model learns single documents by heart and finds 68 in place
of 90 of the 97 toxic documents held out at sf0.1 (3000 words: 89).

Defined results: null and empty texts hold no word; a null ``doc_id`` counts as an empty one for its fold; rows are scored
one by one; null labels are unlabelled; without a toxic label every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import params, training, wordhash
from .lookups import counted

_BEGINNINGS = (5, 6, 7, 8)  # bytes


def _keys(texts: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts[lo:hi] and of the beginnings of longer words, the text of each, and words per text."""
    w = wordhash.words(texts, lo, hi, fold_case=True, plain=True)
    text = w.text_of_word()
    keys, where = [w.hashes()], [text]
    for n in _BEGINNINGS:
        longer = np.flatnonzero(w.end - w.start > n)
        begin = w.start[longer]
        keys.append(w.range_hash(begin, begin + n) ^ np.uint64(n))
        where.append(text[longer])
    return np.concatenate(keys), np.concatenate(where), np.diff(w.first)


def _rates(keys: np.ndarray, text: np.ndarray, n_words: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in ``words`` (sorted) and rate of every word of ``words`` that a text holds. The rate is per hundred
    words, as if each text had 64 more, so that one word makes no short text toxic, and 4 at most."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, keys[hit]), len(words) - 1)
    right = words[at] == keys[hit]
    pair, count = np.unique(text[hit][right] * len(words) + at[right], return_counts=True)
    of, at = pair // len(words), pair % len(words)
    return of, at, np.minimum(100 * count / (n_words[of] + 64), 4.0)


class Model:
    """Words by hash, in order, with their weights."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def scores(self, texts: pa.Array, lo: int, hi: int) -> np.ndarray:
        of, at, rate = _rates(*_keys(texts, lo, hi), self.words)
        return training.sigmoid(np.bincount(of, rate * self.weights[at], minlength=hi - lo) + self.bias)


def _chosen_words(texts: pa.Array, positive: np.ndarray) -> np.ndarray:
    """Words of at least three positives whose mean rates there and in unlabelled text are the most standard errors apart."""
    seen = []
    known = texts.filter(pa.array(positive))
    for lo, hi in wordhash.runs(known):
        keys, text, _ = _keys(known, lo, hi)
        order = np.lexsort((text, keys))
        keys, text = keys[order], text[order]
        seen.append(keys[np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])))] if len(keys) else keys)
    words, docs = np.unique(np.concatenate(seen), return_counts=True)
    words = words[docs >= 3]
    if not len(words):
        return words
    sums = np.zeros((2, 2, len(words)))
    for lo, hi in wordhash.runs(texts):
        of, at, rate = _rates(*_keys(texts, lo, hi), words)
        for side in (0, 1):
            mine = positive[lo:hi][of] == bool(side)
            for power in (1, 2):
                sums[side, power - 1] += np.bincount(at[mine], rate[mine] ** power, minlength=len(words))
    n = np.array([max((~positive).sum(), 1), max(positive.sum(), 1)])[:, None]
    mean = sums[:, 0] / n
    spread = (sums[:, 1] / n - mean**2) / n
    apart = np.abs(mean[1] - mean[0]) / np.sqrt(spread.sum(0) + 1e-9)
    return np.sort(words[np.argsort(-apart, kind="stable")[: params.TOXIC_FEATURES]])


def _risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: np.ndarray, prior: float) -> tuple[float, float, dict[str, np.ndarray]]:
    """Both terms of the risk of a batch, the second one not yet held at zero, and the direction of the step: the gradient of
    their sum, or where the second is below zero that of the second alone, turned round."""
    s_p, s_u = (training.sigmoid(z @ w + b) for z in (p, u))
    # l(g) = sigmoid(-g); its slope in g is -s (1 - s), that of l(-g) is s (1 - s).
    known, clean = prior * (1 - s_p).mean(), s_u.mean() - prior * s_p.mean()
    d_p, d_u = s_p * (1 - s_p) / len(p), s_u * (1 - s_u) / len(u)
    if clean >= 0:
        g_p, g_u = -2 * prior * d_p, d_u
    else:
        g_p, g_u = prior * d_p, -d_u
    return known, clean, {"w": p.T @ g_p + u.T @ g_u, "b": np.array([g_p.sum() + g_u.sum()])}


class _FitPU:
    def __init__(self, prior: float):
        self.prior = prior

    def __call__(self, rows: pa.Table, epochs: int = 60, size: int = 512) -> dict | None:
        texts = wordhash.texts_of(rows.column("text"))
        positive = np.array(rows.column("positive").to_pylist(), bool)
        words = _chosen_words(texts, positive) if positive.any() else np.zeros(0, np.uint64)
        if not len(words):
            return None
        x = np.zeros((len(positive), len(words)), np.float32)
        for lo, hi in wordhash.runs(texts):
            of, at, rate = _rates(*_keys(texts, lo, hi), words)
            x[lo + of, at] = rate
        known, rest = x[positive], x[~positive]
        if not len(rest):
            rest = known
        rng = np.random.default_rng(10)
        weights = {"w": np.zeros(len(words)), "b": np.full(1, -1.0)}
        steps = training.Adam(weights, 0.02, 1e-4)
        per_epoch = max(1, len(rest) // size)
        for _ in range(epochs):
            for _ in range(per_epoch):
                p, u = known[rng.integers(0, len(known), size)], rest[rng.integers(0, len(rest), size)]
                steps.step(_risk(p, u, weights["w"], weights["b"], self.prior)[2])
        return {"words": words, "weights": weights["w"], "bias": float(weights["b"][0])}


class _Score:
    def __init__(self, model: Model | None):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = wordhash.texts_of(batch.column(2))
            for lo, hi in wordhash.runs(texts):
                score = self.model.scores(texts, lo, hi) if self.model else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score.astype(np.float64)),
                     pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``; labels of the fold 0 of 5 are not looked at."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    known = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    known = known.filter((training.fold_of(F.col("doc_id"), 5) != 0) & F.col("label").isNotNull())
    confirmed = known.filter("label = 1").select("doc_id").distinct()
    prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    usable = rows.filter(training.trainable(F.col("text")) & (training.fold_of(F.col("doc_id"), 5) != 0))
    unlabelled = training.sampled(usable.select("doc_id").distinct(), params.TOXIC_UNLABELLED)
    chosen = training.sampled(confirmed, params.TOXIC_POSITIVES).withColumn("positive", F.lit(True)).union(
        unlabelled.withColumn("positive", F.lit(False))
    )
    sample = usable.join(counted(chosen), "doc_id").select("doc_id", "positive", "text")
    made = training.fitted(training.one_text(sample, "doc_id", "positive"), _FitPU(prior), ["doc_id", "text"])
    model = Model(**made) if made else None
    judged = rows.select("doc_id", (training.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return judged.mapInArrow(_Score(model), "doc_id long, held_out boolean, score double, predicted int")
