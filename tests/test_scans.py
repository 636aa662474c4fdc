"""Both plan shapes of scans and folds agree, with one key holding a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from chalkstream.operators import windows as Wn
from chalkstream.plans.folds import Affine, Automaton, ordered_fold
from chalkstream.plans.scans import (
    KeyMax, KeySum, Lag, LastSeen, Lead, RowNumber, RunMax, RunSum, Tail, Total, with_scans,
)
from chalkstream.queries import base as B

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    e = B.ev(spark, SF)
    return e.withColumn("session_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("session_id")))


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() > 0


def test_scans(skewed):
    v, k = F.col("value"), F.col("k")
    some = F.when(k % 3 == 0, v)
    scans = {
        "no": RowNumber(), "lag": Lag(some), "lead": Lead(some), "sum": RunSum(k), "before": RunSum(k, False),
        "max": RunMax(v), "maxb": RunMax(some, False), "last": LastSeen(some), "lastb": LastSeen(some, False),
        "n": Total(), "all": KeySum(k), "top": KeyMax(v), "tail": Tail(v, 7),
    }
    for keys in (["session_id"], []):
        one = with_scans(skewed, keys, ["ts_ms", "event_id"], scans)
        many = with_scans(skewed, keys, ["ts_ms", "event_id"], scans, limit=30)
        same(one, many)


def test_null_key(skewed):
    e = skewed.withColumn("session_id", F.when(F.col("session_id") != 1, F.col("session_id")))
    scans = {"no": RowNumber(), "lag": Lag(F.col("k"))}
    same(with_scans(e, ["session_id"], ["event_id"], scans), with_scans(e, ["session_id"], ["event_id"], scans, limit=30))


def test_affine(skewed):
    e = skewed.select(
        "session_id", "event_id", F.lit(0.75).alias("a"), (F.col("value") * 0.25).alias("b"), F.lit(5.0).alias("lo"), F.lit(60.0).alias("hi")
    )
    fold = Affine(("a", "b", "lo", "hi"), "x", 20.0)
    one = ordered_fold(e, ["session_id"], ["event_id"], fold).withColumn("x", F.round("x", 9))
    many = ordered_fold(e, ["session_id"], ["event_id"], fold, limit=30).withColumn("x", F.round("x", 9))
    same(one, many)


def test_automaton(skewed):
    def move(s, row):
        s += 1
        fire = s >= 3 or (s >= 2 and row[0] < 20)
        return (0 if fire else s), int(fire), int(fire)

    e = skewed.select("session_id", "event_id", "value")
    fold = Automaton(("value",), ("n", "flag", "state"), 4, move)
    same(ordered_fold(e, ["session_id"], ["event_id"], fold), ordered_fold(e, ["session_id"], ["event_id"], fold, limit=30))


def test_operators_survive_small_tasks(spark, skewed):
    order = ["ts_ms", "event_id"]
    needed = skewed.select("session_id", "ts_ms", "event_id", (F.col("value") * 100).alias("needed_ms"))

    def run():
        d = Wn.adaptive_delay(Wn.delay_target(needed, "session_id", order), "session_id", order)
        return d.select("event_id", F.round("delay_ms", 6).alias("d"))

    def strokes():
        e = skewed.withColumn("rms", F.col("value"))
        return Wn.activity_segments(e, "session_id", order, threshold=20.0).select("event_id", "segment", "part")

    def packed():
        pages = skewed.select(F.col("session_id").alias("doc"), (F.col("event_id") % 97).alias("page"), "event_id")
        return Wn.pack_chunks(pages, ["doc"])

    for make in (run, strokes, packed):
        one = make()
        one_rows = sorted(map(tuple, one.collect()))
        spark.conf.set("spark.chalkstream.rowsPerTask", "40")
        try:
            assert sorted(map(tuple, make().collect())) == one_rows
        finally:
            spark.conf.unset("spark.chalkstream.rowsPerTask")


def test_pack_chunks_rule(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 2, 5, 9, 15, 16, 30]) for _ in range(60)]
    rows = [("d", p, i) for p, n in enumerate(sizes) for i in range(n)]
    got = {r["page"]: r["chunk_no"] for r in Wn.pack_chunks(spark.createDataFrame(rows, "doc string, page int, i int"), ["doc"]).collect()}
    chunk, fill, want = 0, 0, {}
    for p, n in enumerate(sizes):
        if fill and fill + n > 15:
            chunk, fill = chunk + 1, 0
        want[p] = chunk
        fill += n
        if fill >= 15:
            chunk, fill = chunk + 1, 0
    assert got == want
