"""Size checks that decide between plans.

A dictionary is broadcast or sent to tasks only after it was counted; a key is windowed in one
task only after its largest group was counted. Both counts read nothing but the columns they
need and are aggregated before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = "spark.chalkstream.rowsPerTask"
BROADCAST_ROWS = "spark.chalkstream.broadcastRows"


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def rows_per_task(spark: SparkSession) -> int:
    """Largest group of rows one task may window or fold."""
    return _setting(spark, ROWS_PER_TASK, 4_000_000)


def small_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of at most about a million rows each; never fewer than cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // 1_000_000))


def broadcast_rows(spark: SparkSession) -> int:
    """Largest table that may be broadcast or handed to tasks."""
    return _setting(spark, BROADCAST_ROWS, 200_000)


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all)."""
    if not keys:
        n = df.count()
        return n, n
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.max("_n").alias("top"), F.sum("_n").alias("rows"))
        .first()
    )
    return int(row["top"] or 0), int(row["rows"] or 0)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no further than the limit needs."""
    cap = broadcast_rows(df.sparkSession) if limit is None else limit
    return df.limit(cap + 1).count() <= cap


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint behind a size check; a larger table is left to a shuffled join."""
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of fewer splits than cores (one small file) work for all cores, by key. A table with
    at least as many splits is returned as it is, so a large one is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
