"""Connected components by alternating stars, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, its smallest reachable node, for all nodes of ``links`` (columns u, v).

    Each round ties the larger neighbours of every node, then the smaller ones, to the smallest
    node seen there. The rounds end when no edge changes; their number grows with the logarithm
    of the longest path. Every round is written, so a lost executor repeats one round at most.
    """
    edges = stage(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _sum_of(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            floor.select("u", F.col("m").alias("v"))
        )
        edges = stage(small.filter("u <> v").distinct(), "edges")
        after = _sum_of(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct()).distinct()
