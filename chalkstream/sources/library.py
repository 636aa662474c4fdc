"""Slide library metadata, page spans, blocks, stage baselines and raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as T
from ..functions.strict_json import is_json
from ..operators.joins import last_translations

LIBRARY_META = (
    "slide_id string, filename string, uploaded_at string, total_pages long, status string, "
    "content_hash string, last_page long"
)
SPAN = "text string, font string, size double, color int, flags int, bbox array<double>"
PAGE_LAYOUT = (
    f"doc_id string, pages array<struct<page:int, blocks:array<struct<type:int, lines:array<struct<"
    f"bbox:array<double>, spans:array<struct<text:string, font:string, size:double, color:int, flags:int, bbox:array<double>>>>>>>>>"
)
EVENT = "type string, ts long, sender_ts long, page long, slide_id string, id string, text string"
KNOWN_EVENTS = (
    "audio", "cursor", "draw_begin", "draw_point", "draw_end", "draw_erase", "draw_clear", "page_change",
    "slide_select", "lecture_start", "lecture_end", "lecture_pause", "lecture_resume", "chat_message",
    "lecture_title", "lecturer_name", "presentation_mode", "participants_request", "transcription", "participants",
    "student_count", "ping", "pong",
)


def library_view(meta: DataFrame, files: DataFrame, translated: DataFrame) -> DataFrame:
    """Library entries with file sizes and whether a translated document exists; defaults fill gaps.
    ``files`` has slide_id and length, ``translated`` has slide_id."""
    marks = translated.select("slide_id").distinct().withColumn("_t", F.lit(True))
    sizes = files.groupBy("slide_id").agg(F.max("length").alias("_len"))
    return (
        meta.join(sizes, "slide_id", "left").join(marks, "slide_id", "left")
        .select(
            "slide_id",
            F.coalesce("filename", F.concat(F.col("slide_id").cast("string"), F.lit(".pdf"))).alias("filename"),
            F.coalesce("uploaded_at", F.lit("")).alias("uploaded_at"),
            F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
            F.coalesce("status", F.lit("completed")).alias("status"),
            F.coalesce("_t", F.lit(False)).alias("has_translated"),
            F.coalesce("_len", F.lit(0)).alias("file_size"),
        )
    )


def scan_library(spark: SparkSession, meta_path: str, upload_path: str, translated_path: str) -> DataFrame:
    """Metadata files joined with the listing of uploads and translated documents. The binary source
    lists names and sizes; file contents are never read."""
    meta = spark.read.schema(LIBRARY_META).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(meta_path)

    def listing(path: str, ending: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(path).select("path", "length")
        stem = F.regexp_extract("path", rf"([^/]+){ending}$", 1)
        return files.select(stem.alias("slide_id"), "length").where("slide_id <> ''")

    return library_view(
        meta.where("slide_id is not null"), listing(upload_path, r"\.pdf"), listing(translated_path, r"_translated\.pdf")
    )


def read_spans(documents: DataFrame) -> DataFrame:
    """Flat spans of nested page documents; non-text blocks and blank spans dropped, pages from 1."""
    p = documents.select("doc_id", F.posexplode("pages").alias("_pi", "_p"))
    b = p.select("doc_id", (F.col("_pi") + 1).alias("page"), F.posexplode("_p.blocks").alias("block_idx", "_b")).where("_b.type = 0")
    ln = b.select("doc_id", "page", "block_idx", F.posexplode("_b.lines").alias("line_idx", "_l"))
    s = ln.select("doc_id", "page", "block_idx", "line_idx", F.posexplode("_l.spans").alias("span_idx", "_s"))
    return s.where(T.strip(F.col("_s.text")) != "").select(
        "doc_id", "page", "block_idx", "line_idx", "span_idx", "_s.*"
    )


def lines_from_spans(
    spans: DataFrame, symbol_fonts: list[str] = P.SYMBOL_FONTS, bullets: list[str] = P.SPAN_BULLETS
) -> DataFrame:
    """Lines from spans: symbol-font and bullet-only spans are left out of the text, mark the line as
    a bullet and, in front of the text, push its left edge. ``text`` is empty for bullet-only lines."""
    key = ["doc_id", "page", "block_idx", "line_idx"]
    font = F.lower(F.coalesce("font", F.lit("")))
    mark = T.contains_any(font, symbol_fonts) | T.strip(F.col("text")).isin(bullets)
    order = F.col("span_idx")
    m = spans.withColumn("_m", mark)
    agg = m.groupBy(*key).agg(
        F.min(F.get("bbox", F.lit(0))).alias("x0"), F.min(F.get("bbox", F.lit(1))).alias("y0"),
        F.max(F.get("bbox", F.lit(2))).alias("x1"), F.max(F.get("bbox", F.lit(3))).alias("y1"),
        F.bool_or("_m").alias("has_bullet"),
        F.min(F.when(~F.col("_m"), order)).alias("_first"),
        F.min_by(F.struct("font", "size", "color"), F.when(~F.col("_m"), order)).alias("_f"),
        F.sort_array(F.collect_list(F.when(~F.col("_m"), F.struct("span_idx", "text")))).alias("_t"),
        F.sort_array(F.collect_list(F.when(F.col("_m"), F.struct("span_idx", F.get("bbox", F.lit(2)).alias("right"))))).alias("_b"),
    )
    ahead = F.filter("_b", lambda b: F.col("_first").isNull() | (b["span_idx"] < F.col("_first")))
    pushed = F.element_at(F.transform(ahead, lambda b: b["right"]), -1)
    return agg.select(
        *key, F.when(F.size(ahead) > 0, F.greatest(F.col("x0"), pushed)).otherwise(F.col("x0")).alias("x0"), "y0", "x1", "y1",
        T.strip(F.array_join(F.transform("_t", lambda t: t["text"]), "")).alias("text"), "has_bullet",
        F.coalesce("_f.font", F.lit("")).alias("font"), F.coalesce("_f.size", F.lit(12.0)).alias("size"),
        F.coalesce("_f.color", F.lit(0)).alias("color"),
    )


def normalize_pages(blocks: DataFrame) -> DataFrame:
    """Zero-based pages for both kinds of block id; the source follows from the id, which is kept."""
    ocr = F.col("block_id").startswith("ocr_")
    return blocks.withColumns(
        {"source": F.when(ocr, "ocr").otherwise("layer"), "page": F.when(ocr, F.col("page")).otherwise(F.col("page") - 1)}
    )


def parse_events(raw: DataFrame, col: str = "value", schema: str = EVENT) -> DataFrame:
    """Messages as typed rows, in batch or stream; unparsable ones dropped, new types kept as unknown."""
    row = F.from_json(col, schema)
    out = raw.where(is_json(F.col(col))).withColumn("_r", row).where(F.col("_r.type").isNotNull())
    return out.select(
        *[c for c in raw.columns if c != col], "_r.*", F.col("_r.type").isin(*KNOWN_EVENTS).alias("known")
    )


def with_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Block table plus translation column (null where there is none)."""
    return blocks.join(last_translations(translations), "block_id", "left")


def write_blocks(blocks: DataFrame, translations: DataFrame, path: str, partition: str = "source") -> None:
    """Block table and block table with translations, partitioned for later stages."""
    blocks.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/blocks")
    with_translations(blocks, translations).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/translated")


def sane_baselines(rows: DataFrame, sanity: dict[str, tuple[float, float]] = P.STAGE_SANITY) -> DataFrame:
    """Stage means inside their range, the latest per stage."""
    lo, hi = F.lit(P.OTHER_STAGE_SANITY[0]), F.lit(P.OTHER_STAGE_SANITY[1])
    for stage, (a, b) in sanity.items():
        lo = F.when(F.col("stage") == stage, a).otherwise(lo)
        hi = F.when(F.col("stage") == stage, b).otherwise(hi)
    good = rows.where((F.col("seconds") > 0) & F.col("seconds").between(lo, hi))
    return good.groupBy("stage").agg(F.max_by("seconds", "saved_at").alias("seconds"))


def save_stage_baselines(rows: DataFrame, path: str) -> None:
    """Append stage means; values out of range are not written."""
    lo, hi = F.lit(P.OTHER_STAGE_SANITY[0]), F.lit(P.OTHER_STAGE_SANITY[1])
    for stage, (a, b) in P.STAGE_SANITY.items():
        lo = F.when(F.col("stage") == stage, a).otherwise(lo)
        hi = F.when(F.col("stage") == stage, b).otherwise(hi)
    rows.where((F.col("seconds") > 0) & F.col("seconds").between(lo, hi)).write.mode("append").parquet(path)


def load_stage_baselines(spark: SparkSession, path: str) -> DataFrame:
    return sane_baselines(spark.read.parquet(path))
