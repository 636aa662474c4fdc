"""Model plumbing with stand-in models."""

import os

from pyspark.sql import functions as F

from chalkstream.operators import inference as I


def test_failures_stay_in_their_batch(spark):
    df = spark.range(0, 20, 1, 1).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))

    def load():
        def call(rows):
            if (rows["id"] == 7).any():
                raise RuntimeError
            return [t.upper() for t in rows["text"]]

        return call

    got = {r.id: (r.result, r.status) for r in I.infer(df, load, batch=5).collect()}
    assert {i for i, (_, s) in got.items() if s == "failed"} == {5, 6, 7, 8, 9} and got[3] == ("T3", "ok")


def counting(folder):
    """A model that needs ``id`` calls for row ``id``; calls are counted in files."""

    def load():
        def call(rows):
            out = []
            for i, t in zip(rows["id"], rows["text"]):
                path = os.path.join(folder, str(i))
                with open(path, "a") as f:
                    f.write("x")
                out.append(t.upper() if os.path.getsize(path) >= i else t)
            return out

        return call

    return load


def test_retry(spark, tmp_path):
    df = spark.range(1, 7).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = {r.id: r.attempt for r in I.retry_failed(df, counting(str(tmp_path)), rounds=3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    assert os.path.getsize(tmp_path / "6") == 4 and os.path.getsize(tmp_path / "1") == 1


def test_retry_until_covered(spark, tmp_path):
    rows = [(1, i, f"t{i}") for i in [1, 1, 1, 1, 3]] + [(2, 2, "t2"), (2, 1, "t1")]
    rows = [(p, i * 100 + n, i, t) for n, (p, i, t) in enumerate(rows)]
    df = spark.createDataFrame([(p, k, t) for p, k, _, t in rows], "page int, id int, text string")

    def load():
        def call(chunk):
            return [t if t == "t3" else t.upper() for t in chunk["text"]]

        return call

    got = {(r.page, r.text): r.result for r in I.retry_until_covered(df, load, "page").collect()}
    assert got == {(1, "t1"): "T1", (2, "t2"): "T2", (2, "t1"): "T1"}


def test_cache(spark, tmp_path):
    df = spark.range(1, 9).select("id", F.lit("t").alias("text"))

    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def load():
        def call(rows):
            for i in rows["id"]:
                with open(os.path.join(calls, str(i)), "a") as f:
                    f.write("x")
            return [f"r{i}" for i in rows["id"]]

        return call

    stage = str(tmp_path / "stage")
    assert I.cached_stage(df.where("id < 4"), "s", load, ["id"], stage).count() == 3
    assert I.cached_stage(df, "s", load, ["id"], stage).count() == 8
    assert all(os.path.getsize(os.path.join(calls, str(i))) == 1 for i in range(1, 9))


def test_fallback(spark):
    df = spark.createDataFrame(
        [(1, "a", "A", "ok", False), (2, "a", "A", "ok", True), (3, "a", None, "failed", False), (4, "a", " ", "ok", False)],
        "id int, text string, result string, status string, leaked boolean")
    assert {r.id: r.final for r in I.fallback_text(df).collect()} == {1: "A", 2: "a", 3: "a", 4: "a"}
