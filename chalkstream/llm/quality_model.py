"""Quality scores by attention over passages (multiple-instance learning).

A document is a bag of passages of 64 words. A passage is encoded from what its bytes look like: shares of 16 kinds of
characters and of their pairs, word lengths, distinct words, and words that repeat elsewhere in the document;
a learned layer turns this into a vector. A gated attention weight per passage is learned from document labels
alone, and the weighted mean of the vectors is scored:

    h = tanh(x E + e)     a ~ exp((tanh(h V) * sigmoid(h U)) w)     score = sigmoid((sum a h) c + d)

The model is fitted in one task on a bounded sample of labelled documents (``TRAIN_DOCS`` of at most
``TRAIN_CHARS`` each) outside the held-out fold; all documents are scored on all their passages.

Defined results: a null or empty text is one passage without features; a null ``doc_id`` counts as an empty one for its
fold; rows are scored one by one; null labels and labels without a document are not learned from; without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import params, training, wordhash
from .lookups import counted

_KINDS = 16
_KIND = np.full(256, 14, np.int64)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n",
                             ".", ",", "!", "#*$%&", "|<>", "\"'()[]{}:;-_", "/\\@^~`+=", "?")):
    _KIND[[ord(c) for c in _chars]] = _i
_KIND[128:192] = 12 + 3
_KIND[192:] = 13
_OTHER = 5
WIDTH = _KINDS * _KINDS + _KINDS + _OTHER


def _share(of: np.ndarray, passages: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(passages, of, minlength=n)


def passages(texts: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of texts[lo:hi], and the number of passages of each text (at least one)."""
    w = wordhash.words(texts, lo, hi, fold_case=False)
    n_words = np.diff(w.first)
    per_text = np.maximum(1, -(-n_words // params.PASSAGE_WORDS))
    begin = np.concatenate(([0], np.cumsum(per_text)))
    total = int(begin[-1])
    text = w.text_of_word()
    within = np.arange(len(text)) - w.first[text]
    of_word = begin[text] + within // params.PASSAGE_WORDS
    # Bytes belong to the passage of the last word begun; those before the first word to the first passage.
    first_byte = np.concatenate((w.start[np.flatnonzero(within % params.PASSAGE_WORDS == 0)], []))
    at = np.empty(total + 1, np.int64)
    at[-1] = len(w.data)
    at[begin[:-1]] = w.at[:-1]
    later = np.ones(total, bool)
    later[begin[:-1]] = False
    at[:-1][later] = first_byte[~np.isin(of_word[within % params.PASSAGE_WORDS == 0], begin[:-1])].astype(np.int64)
    size = np.diff(at)
    of_byte = np.repeat(np.arange(total), size)
    kind = _KIND[w.data]
    # Every text ends with a newline here, and the first one has one before it like all others.
    before = np.concatenate(([_KIND[10]], kind[:-1]))[: len(kind)]
    pairs = np.bincount(of_byte * _KINDS**2 + before * _KINDS + kind, minlength=total * _KINDS**2)
    single = np.bincount(of_byte * _KINDS + kind, minlength=total * _KINDS)
    scale = 1 / np.maximum(size, 1)[:, None]
    words = np.bincount(of_word, minlength=total)
    per_word = 1 / np.maximum(words, 1)
    h = w.hashes()
    fresh = np.zeros(len(h), bool)
    salt = wordhash.mix(of_word.astype(np.uint64) + np.uint64(1))
    fresh[np.unique(h ^ salt, return_index=True)[1]] = True
    windows, window_text = w.windows(h, 3)
    _, inverse, found = np.unique(windows ^ wordhash.mix(window_text.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    place = np.flatnonzero(text[: max(len(text) - 2, 0)] == text[2:])
    again = np.zeros(len(h))
    again[place] = found[inverse] > 1
    other = np.stack([
        _share(w.end - w.start, of_word, total) * per_word / 10, _share(fresh, of_word, total) * per_word,
        _share(again, of_word, total) * per_word, np.log1p(np.repeat(n_words, per_text)) / 5, words / params.PASSAGE_WORDS,
    ], axis=1)
    x = np.concatenate([np.sqrt(pairs.reshape(total, -1) * scale), single.reshape(total, -1) * scale, other], axis=1)
    x[np.repeat(n_words == 0, per_text)] = 0
    return x.astype(np.float32), per_text


class Model:
    """Weights and the scale of the features."""

    HIDDEN, ATTENTION = 24, 12

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.spread, self.w = mean, spread, weights

    @staticmethod
    def start(width: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
        d, k = Model.HIDDEN, Model.ATTENTION

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        return {"E": draw(width, d), "e": np.zeros(d), "V": draw(d, k), "U": draw(d, k), "w": draw(k), "c": draw(d), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Logits of the bags that begin at ``begin`` in ``x`` (already scaled), and what the gradient needs."""
        w = self.w
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), training.sigmoid(h @ w["U"])
        raw = (t * g) @ w["w"]
        a = np.exp(raw - np.maximum.reduceat(raw, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        return z @ w["c"] + w["d"], {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z}

    def gradient(self, x: np.ndarray, s: dict[str, np.ndarray], d_logit: np.ndarray) -> dict[str, np.ndarray]:
        w, bag, h, t, g, a = self.w, s["bag"], s["h"], s["t"], s["g"], s["a"]
        d_z = d_logit[:, None] * w["c"]
        through = (h * d_z[bag]).sum(1)
        d_raw = a * (through - (s["z"] * d_z).sum(1)[bag])
        d_gate = d_raw[:, None] * w["w"]
        d_t, d_g = d_gate * g * (1 - t * t), d_gate * t * g * (1 - g)
        d_h = (a[:, None] * d_z[bag] + d_t @ w["V"].T + d_g @ w["U"].T) * (1 - h * h)
        return {"E": x.T @ d_h, "e": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "w": ((t * g) * d_raw[:, None]).sum(0),
                "c": s["z"].T @ d_logit, "d": d_logit.sum(keepdims=True)}

    def scores(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        begin = np.concatenate(([0], np.cumsum(per_text)[:-1])).astype(np.int64)
        return training.sigmoid(self.forward((x - self.mean) / self.spread, begin)[0])


def fit(rows: pa.Table, epochs: int = 30, bags: int = 128) -> dict:
    """What a ``Model`` is made of, from rows of text and label."""
    texts, labels = wordhash.texts_of(rows.column("text")), rows.column("label").to_numpy().astype(np.float64)
    found = [passages(texts, lo, hi) for lo, hi in wordhash.runs(texts)]
    x, per_text = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    mean, spread = x.mean(0), x.std(0) + 0.05
    x = (x - mean) / spread
    begin = np.concatenate(([0], np.cumsum(per_text)))
    rng = np.random.default_rng(9)
    model = Model(mean, spread, Model.start(x.shape[1], rng))
    steps = training.Adam(model.w, 0.003, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), bags):
            chosen = order[lo : lo + bags]
            size = per_text[chosen]
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.repeat(begin[chosen] - start, size) + np.arange(size.sum())
            batch = x[at]
            logit, state = model.forward(batch, start)
            steps.step(model.gradient(batch, state, (training.sigmoid(logit) - labels[chosen]) / len(chosen)))
    return {"mean": mean, "spread": spread, "weights": model.w}


class _Score:
    def __init__(self, model: Model | None):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = wordhash.texts_of(batch.column(2))
            for lo, hi in wordhash.runs(texts):
                score = self.model.scores(*passages(texts, lo, hi)) if self.model else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score.astype(np.float64)),
                     pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``; labels of the fold 1 of 3 are not looked at."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    known = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    known = known.filter((training.fold_of(F.col("doc_id"), 3) != 1) & F.col("label").isNotNull()).distinct()
    chosen = training.sampled(known, params.TRAIN_DOCS)
    sample = rows.filter(training.trainable(F.col("text"))).join(counted(chosen), "doc_id")
    made = training.fitted(training.one_text(sample, "doc_id", "label"), fit, ["doc_id", "label", "text"])
    model = Model(**made) if made else None
    judged = rows.select("doc_id", (training.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return judged.mapInArrow(_Score(model), "doc_id long, held_out boolean, score double, predicted int")
