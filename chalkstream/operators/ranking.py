"""Sort orders, limits and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scans import RowNumber, with_scans


def sort_library(df: DataFrame, by: str = "recent", locale: str | None = None) -> DataFrame:
    """Newest first, by case-folded name, or largest first; ``locale`` collates names instead."""
    if by == "name":
        name = F.collate(F.col("filename"), locale) if locale else F.lower("filename")
        return df.orderBy(name, "slide_id")
    if by == "size":
        return df.orderBy(F.desc("file_size"), "slide_id")
    return df.orderBy(F.desc("uploaded_at"), "slide_id")


def reading_order(df: DataFrame, page: list[str], tie: list[str]) -> DataFrame:
    """Position by top, then left, within a page."""
    return with_scans(df, page, ["y0", "x0", *tie], {"position": RowNumber()})


def last_n(df: DataFrame, key: str, order: list[str], n: int = 51) -> DataFrame:
    """Most recent ``n`` rows per key: 51 captions, 201 chat messages, 3 shown.

    Spark stops each task at the first ``n`` rows of a key before the shuffle, so a hot key sends at
    most ``n`` rows per task.
    """
    newest = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("recency", F.row_number().over(newest).cast("long")).where(F.col("recency") <= n)
