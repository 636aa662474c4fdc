"""Aggregations. All combine before the shuffle, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import audio, boxes
from ..functions import text as T
from ..functions.generate import rows_of
from .. import params as P
from ..plans.scans import RowNumber, with_scans
from ..plans.sizes import small_tasks


def category_counts(glossary: DataFrame) -> DataFrame:
    """Entries per category in order of first appearance, with the overall total."""
    per = glossary.groupBy("category").agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("first_id"))
    return per.withColumn("total", F.lit(glossary.count())).orderBy("first_id")


def text_layer_stats(
    blocks: DataFrame, pages: DataFrame, doc: str = "doc_id", script: str = P.HANGUL, rows: int | None = None
) -> DataFrame:
    """Text-layer coverage of documents and the way to read them. ``pages`` names the pages, each once or more;
    ``blocks`` has the text blocks with ``page`` and ``text``.

    Most pages hold few blocks, so a table of all pages of a split saves little and takes much of a task's memory: rows
    go to their pages first, in tasks of at most about a million. ``rows`` is at least the number of rows of both, if
    the caller knows it.
    """
    if rows is None:
        rows = blocks.count() + pages.count()
    has = F.coalesce(T.has_class(F.col("text"), script), F.lit(False))
    kinds = pages.select(doc, "page", F.lit(0).cast("byte").alias("_kind")).unionByName(
        # A block of no known page is on no page.
        blocks.where(F.col(doc).isNotNull() & F.col("page").isNotNull()).select(
            doc, "page", F.when(has, 2).otherwise(1).cast("byte").alias("_kind")
        )
    )
    texts = kinds.repartition(small_tasks(kinds.sparkSession, rows), doc, "page").groupBy(doc, "page").agg(
        F.count_if(F.col("_kind") == 0).alias("_p"), F.count_if(F.col("_kind") > 0).alias("_b"),
        F.count_if(F.col("_kind") == 2).alias("_s"),
    )
    per = texts.where("_p > 0").groupBy(doc).agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("_b") > 0).alias("pages_with_text"),
        F.sum("_b").alias("text_blocks"),
        F.sum("_s").alias("script_blocks"),
    )
    cover = F.when(F.col("total_pages") > 0, F.col("pages_with_text") / F.col("total_pages")).otherwise(0.0)
    return per.withColumns(
        {
            "coverage": cover,
            "coverage_rounded": F.bround(cover, 2),
            "recommendation": F.when(cover >= 0.8, "pdf_layer").when(cover >= 0.3, "hybrid").otherwise("ocr"),
        }
    )


def route_pages(page_blocks: DataFrame, page: list[str], min_blocks: int = 2, image_share: float = 0.10) -> DataFrame:
    """Per page: read the text layer, read it and its images, or recognise the whole page.
    ``page_blocks`` has one row per block with ``kind`` (text, image) and the page size."""
    per = page_blocks.groupBy(*page).agg(
        F.count_if(F.col("kind") == "text").alias("text_blocks"),
        F.coalesce(F.sum(F.when(F.col("kind") == "image", boxes.area())), F.lit(0.0)).alias("_image"),
        F.max(F.col("page_width") * F.col("page_height")).alias("_page"),
    )
    share = F.when(F.col("_page") > 0, F.col("_image") / F.col("_page")).otherwise(0.0)
    layer = F.col("text_blocks") >= min_blocks
    return per.withColumn("image_share", share).withColumn(
        "route", F.when(~layer, "ocr").when(share >= image_share, "layer+ocr").otherwise("layer")
    ).drop("_image", "_page")


def paragraph_agg(lines: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Lines of a group become one paragraph: union box, joined text, first line's font, colours.
    A group is one paragraph of one page."""
    first = F.min_by(F.struct("font", "size", "color", "role", "is_bullet"), F.struct(*order))
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col("text").alias("_t"), F.col("color").alias("_c"))))
    out = lines.groupBy(*group).agg(
        *boxes.union_box(), rows.alias("_rows"), first.alias("_first"), F.count(F.lit(1)).alias("n_lines")
    )
    many = F.when(F.col("_first.is_bullet"), "bullet").otherwise("body")
    return out.select(
        *group, *boxes.BOX, "n_lines",
        F.array_join(F.transform("_rows", lambda r: r["_t"]), " ").alias("text"),
        F.col("_first.font").alias("font"), F.col("_first.size").alias("size"), F.col("_first.color").alias("color"),
        F.when(F.col("n_lines") > 1, many).otherwise(F.col("_first.role")).alias("role"),
        F.transform("_rows", lambda r: r["_c"]).alias("line_colors"),
        F.transform("_rows", lambda r: r["_t"]).alias("line_texts"),
        (F.size(F.array_distinct(F.transform("_rows", lambda r: r["_c"]))) > 1).alias("has_multi_color"),
    )


def repeated_words(
    df: DataFrame, key: str, col: str = "text", pattern: str = r"[가-힣]{2,}", pos: str = "pos",
    min_count: int = 2, limit: int | None = 20,
) -> DataFrame:
    """Script words that occur at least twice, in first-seen order; ``limit=None`` keeps all."""
    matches = F.regexp_extract_all(F.col(col), F.lit(f"({pattern})"), F.lit(1))
    found = rows_of(df, matches, "_i", "word", [key, pos])
    counted = (
        found.groupBy(key, "word")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(pos), F.col("_i"))).alias("_first"))
        .where(F.col("n") >= min_count)
    )
    if limit is None:
        return with_scans(counted, [key], ["_first"], {"rank": RowNumber()}).drop("_first")
    # A limited rank keeps at most ``limit`` words per key and task before the shuffle.
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("_first")).cast("long"))
    return ranked.where(F.col("rank") <= limit).drop("_first")


def outcome_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    """Totals by status; anything that is not a known status counts as failed."""
    known = ["replaced", "review_needed", "skipped_invalid"]
    s = F.col("status")
    return outcomes.groupBy(*by).agg(
        *[F.count_if(s == k).alias(k) for k in known],
        F.count_if(~F.coalesce(s.isin(known), F.lit(False))).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def frame_levels(frames: DataFrame) -> DataFrame:
    """RMS and dB per frame with the target band and the peak warning."""
    out = frames.withColumn("rms", audio.rms(F.col("samples")))
    out = out.withColumn("db", audio.decibel(F.col("rms")))
    return out.withColumns(
        {"in_target": F.col("db").between(-20, -15), "peak_warning": F.col("db") >= -6}
    )


def latency_class(ms: Column) -> Column:
    return F.when(ms < 3000, "fast").when(ms < 6000, "medium").otherwise("slow")


def latency_rows(captions: DataFrame) -> DataFrame:
    """Per caption: sum of the stages, end to end, class; first captions (sub_seq 0) marked."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("asr_ms", "nmt_ms", "tts_ms")), F.lit(0))
    return captions.withColumns(
        {
            "total_ms": total,
            "end_to_end_ms": F.col("output_ms") - F.col("input_ms"),
            "latency_class": latency_class(total),
            "is_first": F.col("sub_seq") == 0,
        }
    )


def latency_breakdown(captions: DataFrame, *by: str) -> DataFrame:
    rows = latency_rows(captions)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("captions"),
        F.avg("asr_ms").alias("avg_asr_ms"), F.avg("nmt_ms").alias("avg_nmt_ms"), F.avg("tts_ms").alias("avg_tts_ms"),
        F.avg("total_ms").alias("avg_total_ms"),
        F.avg(F.when(F.col("is_first"), F.col("end_to_end_ms"))).alias("avg_first_caption_ms"),
        *[F.count_if(F.col("latency_class") == c).alias(c) for c in ("fast", "medium", "slow")],
    )


def session_summary(gated: DataFrame, *by: str) -> DataFrame:
    """Segments kept, their span, and what was blocked and why."""
    return gated.groupBy(*by).agg(
        F.count_if("kept").alias("segments"),
        F.count_if(~F.col("kept")).alias("blocked"),
        F.min(F.when(F.col("kept"), F.col("t_offset"))).alias("first_offset"),
        F.max(F.when(F.col("kept"), F.col("t_offset"))).alias("last_offset"),
    )


def response_coverage(responses: DataFrame, requests: DataFrame, key: str, accept: float = 0.8) -> DataFrame:
    """Parsed line numbers in range, extras, missing, and whether the answer is accepted."""
    parsed = responses.select(key, "line_no").distinct()
    judged = parsed.join(requests.select(key, "total_lines"), key)
    ok = (F.col("line_no") >= 1) & (F.col("line_no") <= F.col("total_lines"))
    per = judged.groupBy(key).agg(F.count_if(ok).alias("matched"), F.count_if(~ok).alias("extra"))
    out = requests.select(key, "total_lines").join(per, key, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("matched", "extra")}
    )
    return out.withColumns(
        {
            "missing": F.col("total_lines") - F.col("matched"),
            "accepted": F.col("matched") >= F.col("total_lines") * accept,
        }
    )


def any_in_state(jobs: DataFrame, states: tuple[str, ...] = ("pending", "processing"), col: str = "status") -> DataFrame:
    return jobs.agg(F.coalesce(F.bool_or(F.col(col).isin(*states)), F.lit(False)).alias("busy"))


def layout_summary(blocks: DataFrame, *by: str) -> DataFrame:
    return blocks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("analysed"), F.count_if("on_image_background").alias("on_image")
    )


def collect_corpus(regions: DataFrame, doc: str, order: list[str], col: str = "text") -> DataFrame:
    """Non-empty texts of a document numbered in order, one row each: a document of any size is
    spread over tasks. Page context is the rows numbered up to 20."""
    filled = regions.where(F.coalesce(F.col(col), F.lit("")) != "")
    return with_scans(filled, [doc], order, {"corpus_no": RowNumber()})
