"""From raw documents to token files: quality rules, near duplicates, benchmark leaks, mixing, token ids.

Every stage reads what its predecessor kept and writes Parquet; all but the last keep the columns of
``documents``. Quality rules drop documents that fail, near-dedup keeps one document of each group,
decontamination drops documents that hold a benchmark item, mixing repeats or drops documents to
reach the source targets, and the last stage writes token files and returns what they hold per
document. A stage run on an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chalkstream.llm import decontaminate, minhash, mixing, quality_rules, token_files
from chalkstream.llm.staging import small_batches, stage
from chalkstream.session import table

#: Stages follow one another in the same executors, which keep the room that the largest took.
_BATCH_BYTES = 4 << 20


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, _BATCH_BYTES)
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, _BATCH_BYTES)
    return minhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, _BATCH_BYTES)
    return token_files.write_and_read(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
    ("token files", write_tokens),
]
#: The tokenizer is not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        rows = stage(apply(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
