"""Ranked lexical search: bounds from hashed max-sketches first, exact scores only for what the bounds leave.

A document's sketch is a row of bytes. Each of its terms falls on a coordinate by a hash, and a coordinate holds the
largest term frequency that fell there. With the document's length this is the largest impact there, since impact
grows with frequency; the number of coordinates grows with the number of terms. Sketches know nothing of
queries and are written once.

1. One pass over the documents writes the sketches, with the lengths and the document frequencies of query terms.
2. A block of queries is looked up in a batch of sketches at once: the sum of weight times impact at a term's coordinate
   is an upper bound of the score. The documents with the highest bounds are rescored from their texts; the
   last wanted score among them is the query's threshold.
3. Every document whose bound reaches the threshold is rescored, so no document that belongs to the result is left out.

Queries are taken in blocks of bounded size; a block goes to every task. Candidates (query, document) are counted; up to a
million are sent to every task, more are joined by shuffle. Texts are never shuffled otherwise.

Defined results: a null text has no term; each row is a document of its own, also where ``doc_id`` repeats or is null
(nulls rank last among equal scores); each row of the items is a query of its own; an item without terms, without
documents or without a term in common has no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import params
from .staging import stage

_TABLE = bytearray(range(256))
for _b in range(128):
    if 65 <= _b <= 90:
        _TABLE[_b] = _b + 32
    elif not chr(_b).isalnum():
        _TABLE[_b] = 0x20
_TABLE = bytes(_TABLE)
_FULL = 255  # a frequency of this or more: the impact is bounded by its limit
_MOST_IMPACT = 1_000_000
_CELLS = 1 << 20  # bounds or impacts of a batch computed at once


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and all other characters above 0x7F, A-Z folded."""
    return (text or b"").translate(_TABLE).split()


def _coordinates(found) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


def sketch(counts: Counter) -> bytes:
    """Largest frequency per coordinate; there are 4 to 8 coordinates per term."""
    if not counts:
        return b""
    size = 1 << (4 * len(counts) - 1).bit_length()
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), _FULL)
    at = _coordinates(counts) & np.uint32(size - 1)
    order = np.argsort(tf, kind="stable")
    out = np.zeros(size, np.uint8)
    out[at[order]] = tf[order]  # of several values for one place the last, the largest, stays
    return out.tobytes()


class _Sketches:
    """Sketches of documents, then one row per query term with the documents of the task that hold it."""

    def __init__(self, vocabulary: frozenset, with_sketches: bool):
        self.vocabulary, self.with_sketches = vocabulary, with_sketches

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding: Counter = Counter()
        for batch in batches:
            sizes, rows = [], []
            for value in batch.column(1):
                found = terms(value.as_py())
                counts = Counter(found)
                holding.update(counts.keys() & self.vocabulary)
                if self.with_sketches:
                    sizes.append(len(found))
                    rows.append(sketch(counts))
            if self.with_sketches:
                n = len(rows)
                yield _batch(batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary()),
                             pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()))
        n = len(holding)
        yield _batch(pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                     pa.array(list(holding), pa.binary()), pa.array(list(holding.values()), pa.int64()))


_SKETCHED = "key long, n long, sketch binary, term binary, df long"


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["key", "n", "sketch", "term", "df"])


class Queries:
    """A block of queries: distinct terms with weights, and each query's terms with their repeats."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        counted = [Counter(terms(r[1])) for r in rows]
        self.terms = sorted(set().union(*counted)) if counted else []
        place = {t: i for i, t in enumerate(self.terms)}
        self.items = [(np.array([place[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counted]

    def weigh(self, n_docs: int, n_terms: int, df: dict[bytes, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms], np.int64
        )
        asked = [i for i, (at, _) in enumerate(self.items) if len(at)]
        self.asked = np.array(asked, np.int64)
        self.flat = np.concatenate([self.items[i][0] for i in asked]) if asked else np.zeros(0, np.int64)
        repeats = np.concatenate([self.items[i][1] for i in asked]) if asked else np.zeros(0, np.int64)
        self.factor = self.weights[self.flat] * repeats
        self.begin = np.cumsum([0, *[len(self.items[i][0]) for i in asked[:-1]]]) if asked else np.zeros(0, np.int64)
        self.coordinates = _coordinates(self.terms)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.n_docs) // self.n_terms

    def bounds(self, n: np.ndarray, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds, documents by queries asked, of documents whose sketches have one size."""
        tf = sketches[:, self.coordinates & np.uint32(sketches.shape[1] - 1)].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * self.lengths(n)[:, None])
        impact[tf == _FULL] = _MOST_IMPACT
        return np.add.reduceat(impact[:, self.flat] * self.factor, self.begin, axis=1)

    def score(self, query: int, counts: Counter, n: int) -> int:
        m = int(self.lengths(np.array([n]))[0])
        total = 0
        for at, repeats in zip(*self.items[query], strict=True):
            tf = counts.get(self.terms[at], 0)
            if tf:
                total += int(repeats) * int(self.weights[at]) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        return total


def _looked_up(queries: Queries, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and bounds of the documents of a batch, some at a time."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    n = batch.column(1).to_numpy(zero_copy_only=False)
    sketches = batch.column(2).to_pylist()
    size = np.array([len(s) for s in sketches])
    for s in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == s)
        step = max(1, _CELLS // max(len(queries.flat), len(queries.terms), s))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            matrix = np.frombuffer(b"".join(sketches[i] for i in part), np.uint8).reshape(len(part), s)
            yield keys[part], queries.bounds(n[part], matrix)


def _pairs(query: np.ndarray, key: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(key, pa.int64()), pa.array(bound, pa.int64())],
                                      ["query", "key", "bound"])


class _Highest:
    """The documents of a task with the highest bounds, a fixed number for each query."""

    def __init__(self, queries: Queries, most: int):
        self.queries, self.most = queries, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(self.queries.asked)
        keys, bounds = np.zeros((0, width), np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            for key, bound in _looked_up(self.queries, batch):
                bounds = np.concatenate([bounds, bound])
                keys = np.concatenate([keys, np.broadcast_to(key[:, None], bound.shape)])
                if len(bounds) > self.most:
                    top = np.argpartition(-bounds, self.most - 1, axis=0)[: self.most]
                    bounds, keys = np.take_along_axis(bounds, top, 0), np.take_along_axis(keys, top, 0)
        query = np.broadcast_to(self.queries.asked, bounds.shape)
        some = bounds > 0
        yield _pairs(query[some], keys[some], bounds[some])


class _Reaching:
    """All documents whose bounds reach the thresholds of the queries."""

    def __init__(self, queries: Queries, thresholds: np.ndarray):
        self.queries, self.thresholds = queries, thresholds

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, bound in _looked_up(self.queries, batch):
                row, column = np.nonzero(bound >= self.thresholds)
                yield _pairs(self.queries.asked[column], key[row], bound[row, column])


class _Scores:
    """Exact scores of a document for the queries it may answer, from its whole text."""

    def __init__(self, queries: Queries):
        self.queries = queries

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, asked in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = terms(text.as_py())
                counts = Counter(found)
                out += [(q, doc_id.as_py(), self.queries.score(q, counts, len(found))) for q in asked.as_py()]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "doc_id", "score"])


def _rescored(queries: Queries, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns query, doc_id and score above 0 of candidate pairs."""
    found = stage(pairs, "candidates")
    asked = found.select("query", "key").distinct().groupBy(F.col("key").alias("_key")).agg(F.collect_list("query").alias("asked"))
    if found.count() <= params.BROADCAST_IDS:
        asked = F.broadcast(asked)
    rows = texts.join(asked, texts["key"] == F.col("_key")).select("doc_id", "text", "asked")
    return stage(rows.mapInArrow(_Scores(queries), "query long, doc_id long, score long").filter("score > 0"), "scores")


def _block_rank(queries: Queries, texts: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    spark = texts.sparkSession
    rows = sketches.filter("key is not null and n > 0").select("key", "n", "sketch")
    descending = W.partitionBy("query").orderBy(F.desc("bound"), "key")
    pair = "query long, key long, bound long"
    first = rows.mapInArrow(_Highest(queries, params.SEARCH_FIRST), pair)
    first = first.withColumn("place", F.row_number().over(descending)).filter(F.col("place") <= params.SEARCH_FIRST).drop("place")
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    known = _rescored(queries, texts, first).withColumn("place", F.row_number().over(best))
    reached = {r["query"]: r["score"] for r in known.filter(F.col("place") == most).select("query", "score").collect()}
    thresholds = np.array([reached.get(int(q), 1) for q in queries.asked], np.int64)
    scores = _rescored(queries, texts, rows.mapInArrow(_Reaching(queries, thresholds), pair))
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    ids = spark.createDataFrame(list(enumerate(queries.ids)), "query long, item_id long")
    return ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, most: int = params.SEARCH_MOST, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score``: the ``most`` highest scores of each item."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.xxhash64(docs[doc_id], docs[text]).alias("key"), docs[doc_id].cast("long").alias("doc_id"), body.alias("text"))
    asked = items.select(items[item_id].cast("long").alias("item_id"), F.coalesce(items[item_text].cast("string"), F.lit("")).cast("binary").alias("text"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("bytes")).first()
    blocks = max(-(-size["n"] // params.SEARCH_ITEMS), -(-(size["bytes"] or 0) // params.SEARCH_BYTES))
    result, sketches = None, None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        queries = Queries(sorted(((r[0], bytes(r[1])) for r in block.collect()), key=lambda r: (r[0] is not None, r[0], r[1])))
        if not queries.terms:
            continue
        passed = stage(texts.select("key", "text").mapInArrow(_Sketches(frozenset(queries.terms), sketches is None), _SKETCHED), "sketches")
        sketches = passed if sketches is None else sketches
        whole = sketches.filter("key is not null").agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not whole["docs"]:
            continue
        df = {bytes(r[0]): r[1] for r in passed.filter("term is not null").groupBy("term").agg(F.sum("df")).collect()}
        queries.weigh(whole["docs"], whole["terms"], df)
        part = _block_rank(queries, texts, sketches, most)
        result = part if result is None else result.union(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if result is None else result
