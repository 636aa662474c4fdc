"""Quality rules whose limits follow the data.

Counts per document are taken once. Their ratios go into one quantile sketch per language and
source: counts per bucket of a fixed grid (exact below 256, then 128 buckets per power of two), so
sketches merge by adding and give the same result in any order. Limits are fences around the
median, a few widths away, where the width is the distance from the median to the outer decile on
the good side, with a least width; up to half of a group may be junk without moving them far.
Groups with few documents borrow the sketch of their language, then of all documents. The limits
are joined back to the documents.

Defined results: a null or empty text has no words and fails; rows with one id are judged on their own
text; null languages and sources are groups of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import params, wordhash
from .lookups import lookup
from .staging import stage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _per_text(n: int, text: np.ndarray) -> np.ndarray:
    return np.bincount(text, minlength=n).astype(np.int64)


def _later_equal(keys: np.ndarray) -> np.ndarray:
    """True for every key that an earlier position holds too."""
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return later


def _salted(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one text."""
    return h ^ wordhash.mix(text.astype(np.uint64) + np.uint64(1))


_RUN_BYTES = wordhash.BATCH_BYTES // 2  # texts counted at once


def _counts(texts: pa.Array, lo: int, hi: int) -> np.ndarray:
    w = wordhash.words(texts, lo, hi, fold_case=False)
    n = hi - lo
    out = np.zeros((len(COUNTS), n), np.int64)
    out[0] = np.diff(w.first)
    points = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    word_points = np.concatenate(([0], np.cumsum(points[w.end] - points[w.start])))
    out[1] = np.diff(word_points[w.first])
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[w.data])))
    out[2] = np.diff(symbols[w.at])
    # Lines end at a newline; each text ends with one of its own.
    line_end = np.flatnonzero(w.data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    text = np.searchsorted(w.at, line_start, "right") - 1
    has_word = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    text, line_start, line_end = text[has_word], line_start[has_word], line_end[has_word]
    keys = _salted(w.range_hash(line_start, line_end), text)
    out[3] = _per_text(n, text[_later_equal(keys)])
    # Words covered by a window of three that the text holds at least twice.
    h, text = w.windows(w.hashes(), 3)
    _, inverse, found = np.unique(_salted(h, text), return_inverse=True, return_counts=True)
    lead = np.flatnonzero(found[inverse] >= 2)
    covered = np.zeros(len(w.start) + 2, bool)
    place = _window_place(w)
    for i in range(3):
        covered[place[lead] + i] = True
    out[4] = np.diff(np.concatenate(([0], np.cumsum(covered[: len(w.start)])))[w.first])
    return out


def _window_place(w: wordhash.Words) -> np.ndarray:
    """Word position at which each window of three starts."""
    text = w.text_of_word()
    m = max(len(text) - 2, 0)
    return np.flatnonzero(text[:m] == text[2:])


class _Counts:
    """Adds the counts of the texts in column ``at``, of which the first ``keep`` columns go on."""

    def __init__(self, at: int, keep: int):
        self.at, self.keep = at, keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = wordhash.texts_of(batch.column(self.at))
            parts = [_counts(texts, lo, hi) for lo, hi in wordhash.runs(texts, _RUN_BYTES)]
            found = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
            kept = [batch.column(i) for i in range(self.keep)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], [*batch.schema.names[: self.keep], *COUNTS])


def count(docs: DataFrame, keep: dict[str, str], text: str = "text") -> DataFrame:
    """The counts of every document beside the columns ``keep`` (new name to name). Texts that are kept are sent once."""
    chosen = docs.select(*[docs[old].alias(new) for new, old in keep.items()])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields]
    at = list(keep.values()).index(text) if text in keep.values() and docs.schema[text].dataType == T.StringType() else len(keep)
    if at == len(keep):
        chosen = docs.select(*[docs[old].alias(new) for new, old in keep.items()], docs[text].cast("string").alias("_text"))
    return chosen.mapInArrow(_Counts(at, len(keep)), ", ".join([*fields, *[f"{c} long" for c in COUNTS]]))


def base_failed() -> Column:
    return (F.col("n_words") < params.MIN_WORDS) | (
        100 * F.col("n_repeat_words") > params.MAX_REPEAT_PERCENT * F.col("n_words")
    )


def ratios() -> dict[str, Column]:
    """What the fences look at. Rows without words fail before and have none."""

    def share(name: str, times: int) -> Column:
        return F.expr(f"{name} * {times} div nullif(n_words, 0)")

    return {
        "length": share("word_chars", 100),
        "symbols": share("n_symbols", 1000),
        "dup_lines": share("n_dup_lines", 1000),
        "repeats": share("n_repeat_words", 1000),
    }


WIDTHS = {
    "length": params.LENGTH_WIDTH, "symbols": params.SYMBOL_WIDTH,
    "dup_lines": params.DUP_LINE_WIDTH, "repeats": params.REPEAT_WIDTH,
}


def bucket(v: Column) -> Column:
    """Lower end of the value's bucket."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 8)
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """One row per language, source, ratio and bucket with its count; sketches merge by adding ``n``."""
    rows = counts.filter(~base_failed()).select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in ratios().items()]))
        .alias("_s"),
    ).select("lang", "source", "_s.*")
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Low, middle and high decile per key and ratio: the first bucket at which the count reaches the share."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "metric")
    reach = merged.select(
        "*", F.sum("n").over(w.orderBy("bucket")).alias("_upto"), F.sum("n").over(w).alias("_all")
    )
    at = [F.min(F.when(F.col("_upto") * 10 >= F.col("_all") * k, F.col("bucket"))).alias(q)
          for q, k in (("lo", 1), ("mid", 5), ("hi", 9))]
    return reach.groupBy(*keys, "metric").agg(*at, F.max("_all").alias("docs"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """The fences of every language and source, as columns ``<ratio>_min`` and ``<ratio>_max``."""
    own = _quantiles(sketch, ["lang", "source"])
    by_lang = _quantiles(sketch, ["lang"]).select(
        F.col("lang").alias("_l"), F.col("metric").alias("_m"), *[F.col(c).alias(f"l_{c}") for c in ("lo", "mid", "hi", "docs")]
    )
    over_all = _quantiles(sketch, []).select(
        F.col("metric").alias("_m2"), *[F.col(c).alias(f"a_{c}") for c in ("lo", "mid", "hi")]
    )
    rows = own.join(by_lang, own.lang.eqNullSafe(by_lang["_l"]) & (own.metric == by_lang["_m"]))
    rows = rows.join(over_all, rows.metric == over_all["_m2"])

    def level(q: str) -> Column:
        return (F.when(F.col("docs") >= params.SKETCH_MIN_DOCS, F.col(q))
                .when(F.col("l_docs") >= params.SKETCH_MIN_DOCS, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}")))

    width = F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv])[F.col("metric")].cast("long")
    up = F.greatest(level("mid") - level("lo"), width)
    down = F.greatest(level("hi") - level("mid"), width)
    rows = rows.select(
        "lang", "source", "metric",
        (level("mid") + params.FENCE * up).alias("top"), (level("mid") - params.FENCE * down).alias("bottom"),
    )
    return rows.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("top"))).alias(f"{m}_max") for m in WIDTHS],
        F.max(F.when(F.col("metric") == "length", F.col("bottom"))).alias("length_min"),
    )


def verdict() -> Column:
    inside = [v <= F.col(f"{m}_max") for m, v in ratios().items()]
    ok = inside[0] & (ratios()["length"] >= F.col("length_min"))
    for x in inside[1:]:
        ok = ok & x
    return ~base_failed() & F.coalesce(ok, F.lit(False))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row, with the limits of its group."""
    counts = stage(count(docs, {"doc_id": doc_id, "lang": lang, "source": source}, text), "quality-counts")
    limits = stage(thresholds(sketches(counts)), "quality-limits")
    rows = lookup(counts, limits, {"lang": "lang", "source": "source"}, F.col("doc_id"))
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"), verdict().alias("kept"),
                       *[c for c in limits.columns if c not in ("lang", "source")])


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with. Texts are counted again rather than shuffled."""
    counts = count(docs, {"lang": lang, "source": source}, text)
    limits = stage(thresholds(sketches(counts)), "quality-limits")
    given = [f"_in{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*given)
    at = dict(zip(docs.columns, given, strict=True))
    counted = count(rows, {**{g: g for g in given}, "lang": at[lang], "source": at[source]}, at[text])
    good = lookup(counted, limits, {"lang": "lang", "source": "source"}, F.col("n_words")).filter(verdict())
    return good.select(*[F.col(g).alias(c) for c, g in zip(docs.columns, given, strict=True)])
