"""Levels of sample arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.size(samples))


def decibel(level: Column, floor: float = 1e-10) -> Column:
    return F.log10(F.greatest(level, F.lit(floor))) * 20
