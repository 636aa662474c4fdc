"""Mixing sources to target weights.

Words are added up per source. Each source gets its weight's share of the mix, at most twice what
it holds; what is cut off goes to the others by weight until none is above. A source's repetition
rate is its target over its words: every document is emitted floor(rate) times, and once more if a
number in [0, 1) taken from a hash of the seed and its id lies below the fraction. A rerun takes
the same copies, and no task needs to know of another.

Defined results: null and empty texts have size 0 and are emitted as often as others of their
source; a source without words has target 0 and is not emitted; the null source comes last in the order of weights; a null
``doc_id`` is drawn as an empty id; rows with one ``doc_id`` are drawn alike; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scans import RowNumber, with_scans
from . import params
from .lookups import lookup
from .staging import stage


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id only: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{params.MIX_SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """``source_size``, ``target`` and ``rate`` per source of rows with source and size."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = total.select("*", F.isnull("source").alias("_last"), F.lit(0).alias("_all"))
    ranked = with_scans(total, ["_all"], ["_last", "source"], {"_rank": RowNumber()})
    weights = F.array(*[F.lit(w) for w in params.MIX_WEIGHTS])
    ranked = stage(
        ranked.select(
            "source", "source_size", (params.MIX_MOST * F.col("source_size")).alias("cap"),
            F.get(weights, ((F.col("_rank") - 1) % len(params.MIX_WEIGHTS)).cast("int")).alias("weight"),
        ),
        "sources",
    )
    # The words a unit of weight gets: raised as sources reach their cap, until no further one does.
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        raised = (params.MIX_SHARE * row["words"] - row["taken"]) / row["open"]
        if raised == level:
            break
        level = raised
    target = F.least(F.col("cap").cast("double"), F.lit(float(level or 0)) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return stage(ranked.select("source", "source_size", target.alias("target"), rate.alias("rate")), "rates")


def copies(rate: Column, doc_id: Column) -> Column:
    whole = F.floor(rate)
    return whole + (draw(doc_id) < rate - whole).cast("long")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document the mix takes."""
    sizes = stage(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), size_of(docs[text]).alias("size")), "sizes")
    rows = lookup(sizes, targets(sizes), {"source": "source"}, F.col("doc_id"))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"))).alias("taken")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    rates = targets(docs.select(docs[source].alias("source"), size_of(docs[text]).alias("size"))).select("source", "rate")
    given = [f"_in{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, given, strict=True))
    rows = lookup(docs.toDF(*given), rates, {at[source]: "source"}, F.col(at[doc_id]))
    counted = rows.withColumn("_copies", copies(F.col("rate"), F.col(at[doc_id]))).filter("_copies > 0")
    again = counted.select(*given, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return again.select(*[F.col(g).alias(c) for c, g in zip(docs.columns, given, strict=True)])
