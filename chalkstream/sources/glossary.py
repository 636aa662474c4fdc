"""Glossary and dictionary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as T
from ..plans.scans import LastSeen, RowNumber, with_scans


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 0-based number. Splits of a file are ordered by their offset."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_in_split"),
    )
    out = with_scans(lines, ["_file"], ["_start", "_in_split"], {"_n": RowNumber()})
    return out.select("_file", (F.col("_n") - 1).alias("line_no"), "value")


def sectioned(lines: DataFrame, file: str = "_file", default: str = P.DEFAULT_CATEGORY) -> DataFrame:
    """Entries of numbered lines, each with the category of the last section comment above it."""
    row = F.from_csv("value", "korean string, english string", {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    cells = lines.withColumn("_r", row).withColumn("_key", T.strip(F.coalesce("_r.korean", F.lit(""))))
    name = T.strip(F.regexp_extract("_key", r"^#.*?=+\s*(.+?)\s*=+", 1))
    cells = cells.withColumn("_section", F.when(F.col("_key").startswith("#") & (name != ""), name))
    filled = with_scans(cells, [file], ["line_no"], {"_category": LastSeen(F.col("_section"))})
    header = (F.col("line_no") == 0) & (F.lower("_key") == "korean")
    entry = (F.col("_key") != "") & ~F.col("_key").startswith("#") & F.col("value").contains(",") & ~header
    return filled.where(entry).select(
        F.col("line_no").cast("long").alias("id"), F.col("_key").alias("term"),
        T.strip(F.coalesce("_r.english", F.lit(""))).alias("value"),
        F.coalesce("_category", F.lit(default)).alias("category"),
    )


def read_sectioned_glossary(spark: SparkSession, path: str) -> DataFrame:
    """``korean,english`` rows under ``# ===== name =====`` comments."""
    return sectioned(_numbered_lines(spark, path))


def dictionary_rows(rows: DataFrame, min_len: int = 2, pos: str = "line_no") -> DataFrame:
    """Trimmed pairs without empty, comment and short keys; the last duplicate wins."""
    clean = rows.select(pos, T.strip(F.col("term")).alias("term"), T.strip(F.col("value")).alias("value")).where(
        (F.col("term") != "") & (F.col("value") != "") & ~F.col("term").startswith("#") & (F.length("term") >= min_len)
    )
    return clean.groupBy("term").agg(F.max_by("value", pos).alias("value"))


def read_dictionary(spark: SparkSession, path: str, min_len: int = 2) -> DataFrame:
    """Two-column file with a header, longest key first."""
    row = F.from_csv("value", "term string, value string", {})
    cells = _numbered_lines(spark, path).where("line_no > 0").select("line_no", row.alias("_r")).select("line_no", "_r.*")
    return dictionary_rows(cells, min_len).orderBy(F.desc(F.length("term")), "term")


def glossary_order(glossary: DataFrame, default: str = P.DEFAULT_CATEGORY) -> DataFrame:
    """Entries numbered inside their category in entry order. The default category comes first, the
    rest ascending; ``category_no`` ranks the categories, not the rows."""
    names = glossary.select("category").distinct()
    ranked = with_scans(
        names.withColumn("_rank", (F.col("category") != default).cast("int")), [], ["_rank", "category"], {"category_no": RowNumber()}
    ).drop("_rank")
    placed = with_scans(glossary, ["category"], ["id"], {"entry_no": RowNumber()})
    return placed.join(ranked, "category")


def write_glossary(glossary: DataFrame, path: str) -> None:
    """One directory per category, numbered in reading order, entries in order inside. Large
    categories are divided over files by entry ranges."""
    out = glossary_order(glossary).repartitionByRange("category_no", "entry_no").sortWithinPartitions("category_no", "entry_no")
    out.select("category_no", "category", F.col("term").alias("korean"), F.col("value").alias("english")).write.mode(
        "overwrite"
    ).partitionBy("category_no", "category").option("header", True).csv(path)
