"""Dictionaries too large for a task: every text meets only the terms that can occur in it.

A term is anchored on one run of its characters: 1, 2, 4 or 8 of them, the most that fit, and of these runs
the one that the fewest terms share. Texts are cut into short overlapping blocks, which give the hashes of their
runs; equal hashes meet in a shuffled join. What comes out is a short list of terms per distinct text, still to be
verified by the operator that uses it. Neither the dictionary nor a list of it is fetched or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.generate import rows_of
from ..session import cut_lineage

SIZES = (8, 4, 2, 1)
#: Characters of a block; looking up a character costs as many steps as lie before it in its block.
BLOCK = 128


def _runs(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


class Anchors:
    """The anchored dictionary, written once. Empty terms match nothing; one value is kept per term, the
    greatest."""

    def __init__(self, terms: DataFrame):
        one = terms.where("term <> ''").groupBy("term").agg(F.max("value").alias("value"))
        size = F.coalesce(*[F.when(F.length("term") >= n, F.lit(n)) for n in SIZES])
        pieces = F.coalesce(*[F.when(F.col("size") == n, _runs(F.col("term"), n)) for n in SIZES])
        runs = rows_of(one.withColumn("size", size), F.array_distinct(pieces), "_no", "run")
        holders = runs.groupBy("run").agg(F.count(F.lit(1)).alias("holders"))
        best = runs.join(holders, "run").groupBy("term", "value", "size").agg(
            F.min(F.struct("holders", "_no", "run"))["run"].alias("run")
        )
        self.rows = cut_lineage(best)
        self.sizes = [r["size"] for r in self.rows.select("size").distinct().collect()]  # four at most
        self.reach = (self.rows.agg(F.max(F.length("term"))).first()[0] or 1) - 1

    def candidates(self, pieces: DataFrame, verified: bool = False) -> DataFrame:
        """``_key``, ``term``, ``value``: terms whose anchor is in a piece of the key; ``verified`` ones are in it."""
        # Each match takes a block and looks ahead over the next seven characters, so no run is torn.
        blocks = F.regexp_extract_all("piece", F.lit(rf"(?s)(?=(.{{1,{BLOCK + 7}}})).{{1,{BLOCK}}}"), F.lit(1))
        keep = ["_key", "piece"] if verified else ["_key"]
        cut = rows_of(pieces, blocks, "_no", "_block").drop("_no")
        runs = F.array_distinct(F.flatten(F.array(*[_runs(F.col("_block"), n) for n in self.sizes])))
        if not self.sizes:
            runs = F.array().cast("array<bigint>")
        met = rows_of(cut, runs, "_no", "run", keep).drop("_no").join(self.rows, "run")
        if verified:
            met = met.where(F.contains("piece", "term"))
        return met.select("_key", "term", "value").distinct()


def _distinct_texts(keyed: DataFrame, col: str) -> DataFrame:
    return keyed.select("_key", F.col(col).alias("piece")).where(F.col("piece").isNotNull()).distinct()


def _lists(found: DataFrame) -> DataFrame:
    """One row per key: ``_terms`` and ``_values``, longest term first, ties by text."""
    own = F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term", "value")))
    return found.groupBy("_key").agg(own.alias("_own")).select(
        "_key", F.col("_own.term").alias("_terms"), F.col("_own.value").alias("_values")
    )


def with_own_terms(df: DataFrame, terms: DataFrame, col: str) -> DataFrame:
    """``df`` with ``_terms`` and ``_values``, the terms that may occur in the text (null: none)."""
    keyed = df.withColumn("_key", text_key(F.col(col)))
    lists = _lists(Anchors(terms).candidates(_distinct_texts(keyed, col)))
    return keyed.join(lists, "_key", "left").drop("_key")


def rewritten(
    df: DataFrame, terms: DataFrame, col: str, out: str, chain: Callable[[list[tuple[str, str]], int], Callable], pad: bool = False,
) -> DataFrame:
    """Chained replacement with a dictionary of any size; adds ``out``.

    A replacement can form terms that the text did not hold. Each run therefore tells the surroundings of
    all it replaced; terms found there and not listed yet are added, and those texts run again from the start.
    A text whose surroundings hold nothing new has met every term in its turn. ``chain(pairs, reach)``
    builds the rewriter of one text.
    """
    keyed = df.withColumn("_key", text_key(F.col(col)))
    anchors = Anchors(terms)
    reach = anchors.reach
    texts = _distinct_texts(keyed, col)
    own = cut_lineage(anchors.candidates(texts))
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("around", T.ArrayType(T.StringType()))])

    @F.pandas_udf(result)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for given, names, values in batches:
            done, around = [], []
            for text, ks, vs in zip(given, names, values, strict=True):
                seen: set[str] = set()
                pairs = [(k, f" {v} " if pad else v) for k, v in zip(ks, vs, strict=True)]
                done.append(chain(pairs, reach)(text, seen))
                around.append(sorted(seen))
            yield pd.DataFrame({"text": done, "around": around})

    finished, left = None, texts
    while True:
        made = left.join(_lists(own), "_key").withColumn("_r", run("piece", "_terms", "_values"))
        made = cut_lineage(made.select("_key", "piece", "_r.text", "_r.around"))
        near = rows_of(made, F.col("around"), "_no", "_w", ["_key"]).select("_key", F.col("_w").alias("piece"))
        fresh = cut_lineage(
            anchors.candidates(near, verified=True).join(own.select("_key", "term"), ["_key", "term"], "left_anti")
            .select("_key", "term", "value")
        )
        again = fresh.select("_key").distinct()
        settled = made.join(again, "_key", "left_anti").select("_key", F.col("text").alias(out))
        finished = settled if finished is None else finished.union(settled)
        if fresh.isEmpty():
            break
        left = made.join(again, "_key", "left_semi").select("_key", "piece")
        own = cut_lineage(own.join(again, "_key", "left_semi").union(fresh))
    joined = keyed.join(finished, "_key", "left").drop("_key")
    return joined.withColumn(out, F.coalesce(out, F.col(col)))
