"""Rows from arrays that are costly to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, array: Column, pos: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element with its position. A plain explode lets the planner infer a filter on the
    array's size, which computes the array again below the explode; the outer form with a filter on
    the position computes it once."""
    cols = df.columns if keep is None else keep
    return df.select(*cols, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())
