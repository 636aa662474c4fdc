"""Tables that cut lineage, written to the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

_WRITTEN: list[str] = []


_BATCH_ROWS = 2000
_BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, most: int = _BATCH_BYTES) -> None:
    """Documents are long rows: fewer of them at once between Spark and Python than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= _BATCH_ROWS:
        spark.conf.set(key, str(_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` that no other run uses."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once and read them back: later steps survive lost executors without redoing earlier ones."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``stage`` has written; call it once the results that read it are written."""
    jvm = spark._jvm
    for path in _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.clear()
