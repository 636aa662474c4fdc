"""Joins with a table that is small as a rule, sent to every task only after a count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import params

_SALTS = 64


def counted(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count shows it to be small."""
    return F.broadcast(df) if df.count() <= params.BROADCAST_IDS else df


def lookup(rows: DataFrame, values: DataFrame, on: dict[str, str], salt: Column) -> DataFrame:
    """Left join of ``rows`` with ``values``; ``on`` maps key columns of rows to those of values, nulls match.

    A large table of values is joined by shuffle: each key is then dealt over ``_SALTS`` parts by ``salt``, a
    column of rows, with a copy of its values in each part, so one frequent key fills no single task."""
    keys = {v: f"_lookup_{v}" for v in on.values()}
    right = values.select(*[F.col(v).alias(k) for v, k in keys.items()], *[c for c in values.columns if c not in keys])
    same = [F.col(r).eqNullSafe(F.col(keys[v])) for r, v in on.items()]
    if values.count() <= params.BROADCAST_IDS:
        joined = rows.join(F.broadcast(right), reduce(lambda a, b: a & b, same), "left")
        return joined.drop(*keys.values())
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("_lookup_salt"))
    left = rows.withColumn("_row_salt", F.pmod(F.xxhash64(salt), F.lit(_SALTS)))
    same.append(F.col("_row_salt") == F.col("_lookup_salt"))
    joined = left.join(right, reduce(lambda a, b: a & b, same), "left")
    return joined.drop("_row_salt", "_lookup_salt", *keys.values())
