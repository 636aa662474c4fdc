"""Near-duplicate documents by MinHash with tensored banding, links confirmed on whole shingle sets.

Two collections of half keys are computed per document, each half joining two minima. Every pair
of a half from the first and a half from the second collection is a table key, so 2 x 16 halves
(64 minima) serve 256 tables that would need 1024 minima of their own.

1. Equal sets are one class; only a class's smallest document goes on.
2. Keys are formed for documents that share a half of the first collection with another class. In
   each bucket the smallest document is the pivot; a document is compared with the pivots it
   shares most keys with. Confirmed links give components.
3. What shares a bucket but not a component is settled without pairing buckets: in the order
   "shingles of one component first, then rarer ones first", two sets of similarity 0.75 share a
   shingle among the first n - ceil(0.75 n) + 1 of each. Only these meet, and only across
   components; a long passage held by many documents sorts behind their own shingles.

Defined results: texts without words have an empty set and are linked with nothing; fewer than
five words are one shingle; a null ``doc_id`` is linked with nothing, has no component and is kept; rows that
repeat a ``doc_id`` are one document and share its component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import params, wordhash
from .components import components
from .lookups import counted
from .staging import stage
from .worker import give_back

_rng = np.random.default_rng(75)
_N_MIN = 2 * params.HALVES * params.HALF_ROWS
_MULTIPLY = _rng.integers(1, 1 << 63, _N_MIN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, _N_MIN, dtype=np.uint64)
_MARK = _rng.integers(1, 1 << 63, 2, dtype=np.uint64)
_SHORT = np.uint64(0x5851F42D4C957F2D)
_BITMAP = 1024


def _shingle_sets(texts: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts in one array, sorted inside each text, and where each text begins."""
    w = wordhash.words(texts, lo, hi, fold_case=True)
    h = w.hashes()
    n = hi - lo
    all_windows, text = w.windows(h, params.SHINGLE_WORDS)
    first = np.searchsorted(text, np.arange(n + 1))
    sets = []
    for d in range(n):
        a, b = w.first[d], w.first[d + 1]
        if first[d] < first[d + 1]:
            s = np.sort(all_windows[first[d] : first[d + 1]])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif a < b:
            with np.errstate(over="ignore"):
                acc = np.uint64(b - a) * _SHORT
                for x in h[a:b]:
                    acc = acc * _SHORT + x
            sets.append(wordhash.mix(np.array([acc])))
        else:
            sets.append(np.zeros(0, np.uint64))
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), begin


def _signatures(texts: pa.Array, lo: int, hi: int) -> list[np.ndarray]:
    """Set sizes, two marks of the whole set, and the halves of both collections; empty sets have marks of 0."""
    shingles, begin = _shingle_sets(texts, lo, hi)
    size = np.diff(begin)
    full = np.flatnonzero(size)
    at = begin[full]
    n = hi - lo
    marks = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    halves = np.zeros((n, 2 * params.HALVES), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            marks[0][full] = np.add.reduceat(wordhash.mix(shingles ^ _MARK[0]), at)
            marks[1][full] = np.bitwise_xor.reduceat(wordhash.mix(shingles ^ _MARK[1]), at)
            for k in range(2 * params.HALVES):
                acc = np.full(len(full), k + 1, np.uint64)
                for r in range(k * params.HALF_ROWS, (k + 1) * params.HALF_ROWS):
                    least = np.minimum.reduceat(shingles * _MULTIPLY[r] + _ADD[r], at)
                    acc = wordhash.mix(acc * _SHORT + least)
                halves[full, k] = acc
    return [size, *marks, halves]


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = wordhash.texts_of(batch.column(1))
        for lo, hi in wordhash.runs(texts):
            size, m1, m2, halves = _signatures(texts, lo, hi)
            step = np.arange(hi - lo + 1) * params.HALVES
            sides = [_lists(np.ascontiguousarray(x).ravel(), step) for x in np.split(halves, 2, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(m1.view(np.int64)),
                 pa.array(m2.view(np.int64)), *sides],
                ["doc_id", "n", "m1", "m2", "a", "b"],
            )
    give_back()


def _bitmaps(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """1024 bits per text, one set for each shingle by its lowest bits, as rows of 16 words."""
    out = np.zeros((len(begin) - 1, _BITMAP // 64), np.uint64)
    for lo in range(0, len(out), 4096):
        hi = min(lo + 4096, len(out))
        text = np.repeat(np.arange(hi - lo), np.diff(begin[lo : hi + 1]))
        bits = np.zeros((hi - lo) * _BITMAP, bool)
        bits[text * _BITMAP + (shingles[begin[lo] : begin[hi]] % np.uint64(_BITMAP)).astype(np.int64)] = True
        out[lo:hi] = np.packbits(bits, bitorder="little").view(np.uint64).reshape(hi - lo, -1)
    return out


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = wordhash.texts_of(batch.column(1))
        for lo, hi in wordhash.runs(texts):
            shingles, begin = _shingle_sets(texts, lo, hi)
            bitmap = _lists(_bitmaps(shingles, begin).ravel(), np.arange(hi - lo + 1) * (_BITMAP // 64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(begin)), _lists(shingles, begin), bitmap],
                ["node", "n", "shingles", "bits"],
            )
    give_back()


def _pivots(classes: DataFrame) -> DataFrame:
    """Columns x, p, shared: documents and the pivots of their buckets, with the number of keys they share."""
    halves = classes.select("node", F.explode("a").alias("half"))
    common = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    shared = halves.join(common, "half").groupBy("node").agg(F.collect_list("half").alias("halves"))
    keys = (
        classes.select("node", "n", "b").join(shared, "node")
        .select("node", "n", "b", F.explode("halves").alias("half"))
        .select("node", "n", "half", F.explode("b").alias("other"))
        .select("node", "n", F.xxhash64("half", "other").alias("key"))
    )
    keys = stage(keys, "keys")
    pivots = keys.groupBy("key").agg(
        F.min("node").alias("p"), F.max("node").alias("last"), F.min_by("n", "node").alias("pn")
    ).filter("p < last").select("key", "p", "pn")
    return (
        keys.join(pivots, "key").filter("node <> p").groupBy(F.col("node").alias("x"), "p")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"), F.max("pn").alias("pn"))
    )


def _close(n: str, m: str) -> str:
    """Sets whose sizes allow the similarity."""
    return f"100 * least({n}, {m}) >= {params.SIMILARITY_PERCENT} * greatest({n}, {m})"


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose whole sets reach the similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("sv"))
    both = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", (F.col("nu") + F.col("nv")).alias("sum"), common.alias("common")).filter(
        f"100 * common >= {params.SIMILARITY_PERCENT} * (sum - common)"
    ).select("u", "v")


def _prefix_pairs(open_nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that can still reach the similarity (columns u, v); exact, see above.

    ``open_nodes`` has node and comp."""
    rows = sets.join(open_nodes, "node").select("node", "n", "comp", F.explode("shingles").alias("s"))
    across = rows.groupBy("s").agg(
        F.count(F.lit(1)).alias("docs"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    ).filter("c0 < c1").select("s", "docs")
    t = params.SIMILARITY_PERCENT
    mine = W.partitionBy("node", "n")
    # ``can``: shingles that another component holds too, so the most a document can have in common. ``pos``: place
    # in the order, the other shingles first.
    placed = rows.join(across, "s").select("*", F.count(F.lit(1)).over(mine).alias("can"), F.row_number().over(mine.orderBy("docs", "s")).alias("rank"))
    placed = placed.select("s", "node", "n", "comp", "can", (F.col("n") - F.col("can") + F.col("rank")).alias("pos"))
    postings = stage(placed.filter(F.expr(f"pos <= n - (n * {t} + 99) div 100 + 1")), "postings")
    main = postings.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).groupBy("s").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.min("n").alias("least")
    ).filter("comps > 1").select("s", "main", "least")
    # With as much in common as it can have, the document must reach the smallest set of the list.
    able = postings.join(main, "s").filter(f"(100 + {t}) * can >= {t} * (n + least)")
    able = able.join(sets.select("node", "n", "bits"), ["node", "n"])
    # All pairs across components hold a row outside the largest component of the shingle.
    strays = able.filter("comp <> main").select("s", *[F.col(c).alias(f"{c}_u") for c in ("node", "n", "comp", "can", "pos", "bits")])
    # The least two sets of these sizes must have in common; both must hold the shingle early enough for that, and a bit
    # set in one bitmap only stands for a shingle of its own.
    need = f"({t} * (n + n_u) + {99 + t}) div {100 + t}"
    words = range(_BITMAP // 64)
    alone = " + ".join(f"bit_count(bits[{i}] & ~bits_u[{i}])" for i in words)
    alone_u = " + ".join(f"bit_count(bits_u[{i}] & ~bits[{i}])" for i in words)
    pairs = strays.join(able, "s").filter(
        f"comp <> comp_u and {_close('n', 'n_u')} and least(can, can_u) >= {need}"
        f" and pos <= n - {need} + 1 and pos_u <= n_u - {need} + 1"
        f" and n - ({alone}) >= {need} and n_u - ({alone_u}) >= {need}"
    )
    return pairs.select(F.least("node_u", "node").alias("u"), F.greatest("node_u", "node").alias("v")).distinct()


def _only(docs: DataFrame, ids: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """Rows whose id is (not) in ``ids``. Few ids are counted and sent to every task; more are joined by shuffle."""
    return docs.join(counted(ids.select(F.col(ids.columns[0]).alias("_only"))), docs[name] == F.col("_only"), how)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable over links) and ``kept``."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = stage(
        texts.mapInArrow(_signature_batches, "doc_id long, n long, m1 long, m2 long, a array<long>, b array<long>"),
        "signatures",
    )
    classes = stage(
        rows.filter("n > 0 and doc_id is not null").groupBy("m1", "m2", "n")
        .agg(F.min("doc_id").alias("node"), F.any_value("a").alias("a"), F.any_value("b").alias("b")),
        "classes",
    )
    pivots = stage(_pivots(classes), "pivots")
    met = stage(pivots.select(F.col("x").alias("node")).union(pivots.select("p")).distinct(), "met")
    sets = stage(
        _only(texts, met, "doc_id")
        .mapInArrow(_set_batches, "node long, n long, shingles array<long>, bits array<long>"),
        "sets",
    )
    best = W.partitionBy("x").orderBy(F.desc("shared"), "p")
    first = pivots.filter(_close("n", "pn")).withColumn("k", F.row_number().over(best)).filter(f"k <= {params.PIVOTS}")
    links = stage(_confirmed(first.select(F.col("x").alias("u"), F.col("p").alias("v")), sets), "links")
    found = stage(components(links), "components")
    # Buckets in which a document lies outside its pivot's component are open.
    of = met.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    of = stage(of, "labels")
    cross = pivots.select("x", "p").join(
        of.select(F.col("node").alias("x"), F.col("comp").alias("cx")), "x"
    ).join(of.select(F.col("node").alias("p"), F.col("comp").alias("cp")), "p").filter("cx <> cp")
    # A link missing between two components may join any of their documents.
    open_comps = cross.select(F.explode(F.array("cx", "cp")).alias("comp")).distinct()
    open_nodes = stage(of.join(open_comps, "comp").select("node", "comp"), "open")
    if open_nodes.limit(1).count():
        more = _confirmed(_prefix_pairs(open_nodes, sets), sets)
        ties = found.select(F.col("node").alias("u"), F.col("comp").alias("v"))
        found = stage(components(more.union(ties)), "components")
    reached = classes.select("m1", "m2", F.col("n").alias("_n"), "node").join(found, "node", "left").select(
        "m1", "m2", "_n", F.coalesce("comp", "node").alias("comp")
    )
    result = rows.select("doc_id", "n", "m1", "m2").join(
        reached, (rows.m1 == reached.m1) & (rows.m2 == reached.m2) & (rows.n == reached["_n"])
        & rows.doc_id.isNotNull() & (rows.n > 0), "left"
    )
    component = F.coalesce("comp", "doc_id")
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns it came with.

    Of rows that repeat an id and its text one stays; different texts of one id all stay if the id does. Rows without an id
    are grouped like others, under ids made from their texts, above 2 ** 62; a document with an id is kept before them.
    Rows with neither an id nor a word all stay."""
    given = [f"_in{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, given, strict=True))
    mark = F.xxhash64(F.coalesce(F.col(at[text]).cast("string"), F.lit("")))
    made = mark.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    made = F.when(F.col(at[text]).cast("string").rlike(r"[^\x20\x09-\x0D]"), made)
    rows = docs.toDF(*given).withColumn("_id", F.coalesce(F.col(at[doc_id]).cast("long"), made)).withColumn("_mark", mark)
    found = groups(rows.select("_id", at[text]), "_id", at[text])
    gone = stage(found.filter("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    left = _only(rows, gone, "_id", "left_anti")
    back = [F.col(g).alias(c) for c, g in zip(docs.columns, given, strict=True)]
    repeated = stage(left.filter("_id is not null").groupBy("_id", "_mark").count().filter("count > 1").select("_id").distinct(), "repeated")
    if not repeated.limit(1).count():
        return left.select(*back)
    once = _only(left, repeated, "_id", "left_anti")
    # The copies meet by id and text, each task's already reduced to one.
    more = _only(left, repeated, "_id", "left_semi").dropDuplicates(["_id", "_mark"])
    return once.union(more).select(*back)
