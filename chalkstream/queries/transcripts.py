"""Transcript, summary and library-source queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import gates as G
from ..operators import transforms as X
from ..operators import windows as Wn
from ..session import checkpoint_dir, table
from ..sources import glossary as SG
from ..sources import library as SL
from ..sources import transcripts as ST
from . import base as B
from .base import query, with_ctes

SRT = """CASE WHEN {0} < 0 THEN '00:00:00,000' ELSE
  printf('%02d:%02d:%02d,%03d', CAST(floor({0}) AS BIGINT) // 3600, CAST(floor({0}) AS BIGINT) % 3600 // 60,
         CAST(floor({0}) AS BIGINT) % 60, CAST(floor(({0} - floor({0})) * 1000) AS BIGINT)) END"""
CUES = """cues AS (
  SELECT *, row_number() OVER w AS cue_no,
    CASE WHEN lead(t_offset) OVER w IS NULL OR lead(t_offset) OVER w - t_offset > 10 THEN t_offset + 4
         ELSE lead(t_offset) OVER w END AS t_end
  FROM segments WINDOW w AS (PARTITION BY session_id ORDER BY seq))"""
REPEAT = """len(list_filter(range(1, length({0}) + 1), lambda i:
    (length(substr({0}, i, 4)) = 4 AND substr({0}, i, 4) = repeat(substr({0}, i, 1), 4)) OR
    (length(substr({0}, i, 8)) = 8 AND substr({0}, i, 8) = repeat(substr({0}, i, 2), 4)) OR
    (length(substr({0}, i, 12)) = 12 AND substr({0}, i, 12) = repeat(substr({0}, i, 3), 4)))) > 0"""
STOCK = ["%%%", r"\*\*\*", "###"]
COURTESY = r"^[A-Z][a-z]{1,5}[\s\.!\?]*$"


@query(
    "lecture_summary",
    with_ctes(
        B.SEGMENTS,
        CUES,
        f"""stripped AS (SELECT * EXCLUDE (original), regexp_replace(original, '^\\s+|\\s+$', '', 'g') AS t FROM cues),
gated AS (
  SELECT *, CASE
    WHEN t = '' THEN 'empty' WHEN length(replace(t, ' ', '')) < 2 THEN 'short' WHEN length(t) > 200 THEN 'long'
    WHEN {REPEAT.format('t')} THEN 'repeated_unit'
    WHEN len(list_filter(regexp_split_to_array(t, '[\\s,]+'), lambda w: w <> '')) >= 8 AND
      len(list_distinct(list_filter(regexp_split_to_array(t, '[\\s,]+'), lambda w: w <> '')))::DOUBLE
      / len(list_filter(regexp_split_to_array(t, '[\\s,]+'), lambda w: w <> '')) < 0.3 THEN 'repeated_words'
    WHEN (length(t) - length(regexp_replace(t, '[\\x00-\\x7f]', '', 'g')))::DOUBLE / length(t) > 0.97 THEN 'ascii'
    WHEN regexp_matches(t, '%%%|\\*\\*\\*|###', 'i') THEN 'stock_phrase'
    WHEN regexp_matches(t, '{COURTESY}') THEN 'courtesy' END AS reason
  FROM stripped)""",
        body="""SELECT session_id, count(*) FILTER (reason IS NULL) AS segments, count(*) FILTER (reason IS NOT NULL) AS blocked,
  min(t_offset) FILTER (reason IS NULL) AS first_offset, max(t_offset) FILTER (reason IS NULL) AS last_offset,
  round(sum(t_end - t_offset), 6) AS shown_seconds
FROM gated GROUP BY session_id""",
    ),
)
def _(spark, sf):
    timed = Wn.cue_times(B.segments(spark, sf))
    gated = G.gate_utterances(
        timed.withColumnRenamed("original", "text"), stock_phrases=STOCK, lone_courtesy=COURTESY, max_ascii=0.97
    )
    summary = A.session_summary(gated, "session_id")
    shown = gated.groupBy("session_id").agg(F.round(F.sum(F.col("t_end") - F.col("t_offset")), 6).alias("shown_seconds"))
    return summary.join(shown, "session_id")


# ------------------------------------------------------------------------------ exports and sources
@query(
    "export_srt",
    with_ctes(B.SEGMENTS, CUES, body=f"""SELECT session_id, cue_no, cue_no || chr(10) || {SRT.format('t_offset')} || ' --> ' || {SRT.format('t_end')}
  || chr(10) || original || chr(10) || translated || chr(10) AS cue FROM cues"""),
)
def _(spark, sf):
    return ST.export_srt(B.segments(spark, sf))


@query(
    "export_txt",
    with_ctes(B.SEGMENTS, "t AS (SELECT *, CAST(floor(t_offset) AS BIGINT) AS s FROM segments)",
              body="""SELECT session_id, seq AS line_no, printf('[%02d:%02d]', s // 60, s % 60) || CASE WHEN page IS NULL THEN '' ELSE ' (page ' || page || ')' END
  || ' ' || original || chr(10) || '          → ' || translated AS line FROM t"""),
)
def _(spark, sf):
    return ST.export_txt(B.segments(spark, sf))


@query(
    "time_format",
    with_ctes(B.SEGMENTS, "t AS (SELECT *, CAST(floor(t_offset) AS BIGINT) AS s FROM segments)",
              body=f"SELECT session_id, seq, {SRT.format('t_offset')} AS srt_time, printf('%02d:%02d', s // 60, s % 60) AS minute_time FROM t"),
)
def _(spark, sf):
    return X.time_format(B.segments(spark, sf)).select("session_id", "seq", "srt_time", "minute_time")


def _log_lines(spark, sf):
    """Session logs as JSON lines, with broken and blank ones in between."""
    s = B.segments(spark, sf)
    line = F.to_json(F.struct(F.col("seq").cast("int").alias("seq"), "t_offset", "original", "translated"))
    k = F.col("seq") % 7
    return s.select("session_id", F.when(k == 3, F.concat(line, F.lit("}"))).when(k == 5, F.lit("  ")).otherwise(line).alias("value"))


@query(
    "finalize_session",
    with_ctes(B.SEGMENTS, """g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS position FROM segments WHERE seq % 7 NOT IN (3, 5))""",
              body="""SELECT session_id, position, NULL AS total_segments, seq, original, translated FROM g
UNION ALL SELECT s.session_id, 0, (SELECT count(*) FROM g WHERE g.session_id = s.session_id), NULL, NULL, NULL FROM (SELECT DISTINCT session_id FROM segments) s"""),
)
def _(spark, sf):
    good = ST.parse_segments(_log_lines(spark, sf))
    meta = B.segments(spark, sf).select("session_id").distinct()
    out = ST.finalize_session(good, meta)
    return out.select(
        "session_id", "position", "total_segments", F.col("segment.seq").alias("seq"), F.col("segment.original").alias("original"),
        F.col("segment.translated").alias("translated"),
    )


@query(
    "list_sessions",
    """SELECT o_orderkey::VARCHAR AS session_id, o_custkey::VARCHAR AS slide_id, epoch_us(o_orderdate) // 1000000 AS started_s, o_orderkey % 13 AS total_segments
FROM orders WHERE o_orderkey % 10 <> 0""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    meta = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_custkey").cast("string").alias("slide_id"),
            F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderkey") % 13).alias("total_segments"),
        )
    )
    raw = o.select(F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("{"), meta)).otherwise(meta).alias("value"))
    return ST.sessions_from(raw).select("session_id", "slide_id", F.unix_seconds("started_at").alias("started_s"), "total_segments")


@query(
    "scan_library",
    with_ctes(B.LIBRARY, """m AS (SELECT slide_id, CASE WHEN slide_id % 3 <> 0 THEN filename END AS filename, uploaded_at, CASE WHEN slide_id % 5 <> 0 THEN status END AS status FROM library)""",
              body="""SELECT slide_id, coalesce(filename, slide_id || '.pdf') AS filename, uploaded_at, coalesce(total_pages, 0) AS total_pages, coalesce(status, 'completed') AS status,
  slide_id IN (SELECT slide_id FROM translated) AS has_translated, coalesce(l, 0) AS file_size
FROM m LEFT JOIN pages_of USING (slide_id) LEFT JOIN (SELECT slide_id, CAST(floor(file_size) AS BIGINT) AS l FROM library WHERE slide_id % 7 <> 0) USING (slide_id)"""),
)
def _(spark, sf):
    lib, k = B.library(spark, sf), F.col("slide_id")
    meta = lib.join(B.pages_of(spark, sf), "slide_id", "left").select(
        "slide_id", F.when(k % 3 != 0, F.col("filename")).alias("filename"), "uploaded_at", "total_pages",
        F.when(k % 5 != 0, F.col("status")).alias("status"),
    )
    files = lib.where(k % 7 != 0).select("slide_id", F.floor("file_size").alias("length"))
    return SL.library_view(meta, files, B.translated(spark, sf))


def _nested(spark, sf):
    """Page documents of up to 64 regions of an order, each a block with a line and three spans."""
    r = B.regions(spark, sf)
    box = F.array("x0", "y0", "x1", "y1")
    span = F.struct(F.col("text").alias("text"), F.lit("sans").alias("font"), "size", "color", F.lit(0).alias("flags"), box.alias("bbox"))
    blank = F.struct(F.lit("  ").alias("text"), F.lit("sans").alias("font"), "size", "color", F.lit(0).alias("flags"), box.alias("bbox"))
    mark = F.struct(
        F.when(F.col("has_bullet"), "•").otherwise("~").alias("text"), F.lit("sans").alias("font"), "size", "color", F.lit(0).alias("flags"),
        F.array(F.col("x0"), F.col("y0"), F.col("x0") + 5, F.col("y1")).alias("bbox"),
    )
    line = F.struct(box.alias("bbox"), F.array(mark, blank, span).alias("spans"))
    block = F.struct("pos", F.when(F.col("color") == 2, 1).otherwise(0).alias("type"), F.array(line).alias("lines"))
    page = r.groupBy("page").agg(F.sort_array(F.collect_list(block)).alias("_b"))
    blocks = F.transform("_b", lambda b: F.struct(b["type"].alias("type"), b["lines"].alias("lines")))
    return page.select(F.col("page").alias("doc_id"), F.array(F.struct(blocks.alias("blocks"))).alias("pages"))


@query(
    "read_spans",
    with_ctes(B.REGIONS, body="""SELECT page AS doc_id, CAST(pos - 1 AS INTEGER) AS block_idx, 0 AS span_idx, CASE WHEN has_bullet THEN '•' ELSE '~' END AS text, x0 FROM regions WHERE color <> 2
UNION ALL SELECT page, CAST(pos - 1 AS INTEGER), 2, text, x0 FROM regions WHERE color <> 2"""),
)
def _(spark, sf):
    s = SL.read_spans(_nested(spark, sf))
    return s.select("doc_id", "block_idx", "span_idx", "text", F.get("bbox", F.lit(0)).alias("x0"))


@query(
    "lines_from_spans",
    with_ctes(B.REGIONS, body="""SELECT page AS doc_id, CAST(pos - 1 AS INTEGER) AS block_idx, CASE WHEN has_bullet THEN text ELSE '~' || text END AS text,
  CASE WHEN has_bullet THEN x0 + 5 ELSE x0 END AS x0, x1, has_bullet FROM regions WHERE color <> 2"""),
)
def _(spark, sf):
    ln = SL.lines_from_spans(SL.read_spans(_nested(spark, sf)))
    return ln.select("doc_id", "block_idx", "text", "x0", "x1", "has_bullet")


@query(
    "normalize_pages",
    """SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'ocr_p' || l_linenumber || '_r1' ELSE 'pdf_p' || l_linenumber || '_b1' END AS block_id,
  CASE WHEN l_returnflag = 'R' THEN 'ocr' ELSE 'layer' END AS source, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE l_linenumber - 1 END AS page FROM lineitem""",
)
def _(spark, sf):
    n = F.col("l_linenumber")
    ids = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("ocr_p"), n.cast("string"), F.lit("_r1"))).otherwise(
        F.concat(F.lit("pdf_p"), n.cast("string"), F.lit("_b1"))
    )
    b = table(spark, sf, "lineitem").select("l_orderkey", n.alias("n"), ids.alias("block_id"), n.alias("page"))
    return SL.normalize_pages(b)


@query(
    "parse_events",
    with_ctes(B.EV, body="""SELECT event_id, CASE event_type WHEN 'click' THEN 'cursor' WHEN 'view' THEN 'page_change' ELSE event_type END AS type, ts_ms AS ts, CASE WHEN event_type = 'view' THEN k END AS page,
  event_type IN ('click', 'view') AS known FROM ev WHERE k % 10 <> 0"""),
)
def _(spark, sf):
    e = B.ev(spark, sf)
    kind = F.when(F.col("event_type") == "click", "cursor").when(F.col("event_type") == "view", "page_change").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(kind.alias("type"), F.col("ts_ms").alias("ts"), F.when(F.col("event_type") == "view", F.col("k")).alias("page")))
    raw = e.select("event_id", F.when(F.col("k") % 10 == 0, F.concat(F.lit("<"), body)).otherwise(body).alias("value"))
    return SL.parse_events(raw).select("event_id", "type", "ts", "page", "known")


@query(
    "write_blocks",
    """SELECT 'p' || conv_id || '_b' || turn AS block_id, role AS source, text, CASE WHEN length(text) % 3 <> 0 THEN 'EN ' || turn END AS translated FROM conversations""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_b"), F.col("turn").cast("string")).alias("block_id"),
        F.col("role").alias("source"), "text", "turn",
    )
    done = c.where(F.length("text") % 3 != 0).select("block_id", F.concat(F.lit("EN "), F.col("turn").cast("string")).alias("translated"))
    path = f"{checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    SL.write_blocks(c.drop("turn"), done, path)
    return spark.read.parquet(f"{path}/translated").select("block_id", "source", "text", "translated")


@query(
    "stage_baselines",
    with_ctes(B.EV, """s AS (SELECT CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'translate' ELSE event_type END AS stage, value * 2 AS seconds, event_id FROM ev)""",
              body="""SELECT stage, max_by(seconds, event_id) AS seconds FROM s WHERE seconds > 0 AND seconds BETWEEN CASE stage WHEN 'ocr' THEN 2 WHEN 'translate' THEN 10 ELSE 0 END
  AND CASE stage WHEN 'ocr' THEN 60 WHEN 'translate' THEN 180 ELSE 600 END GROUP BY stage"""),
)
def _(spark, sf):
    t = F.col("event_type")
    s = B.ev(spark, sf).select(
        F.when(t == "view", "ocr").when(t == "click", "translate").otherwise(t).alias("stage"), (F.col("value") * 2).alias("seconds"),
        F.col("event_id").alias("saved_at"),
    )
    path = f"{checkpoint_dir(spark)}/baselines-{uuid.uuid4().hex}"
    SL.save_stage_baselines(s, path)
    return SL.load_stage_baselines(spark, path)


def _glossary_lines(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    entries = p.select((k * 2 + 1).alias("line_no"), F.concat("p_name", F.lit(" , "), "p_brand").alias("value"))
    heads = p.where(k % 50 == 0).select((k * 2).alias("line_no"), F.concat(F.lit("# ===== "), "p_type", F.lit(" =====,")).alias("value"))
    notes = p.where(k % 50 == 7).select((k * 2).alias("line_no"), F.lit("# a note").alias("value"))
    return entries.unionByName(heads).unionByName(notes).withColumn("_file", F.lit("glossary.csv"))


@query(
    "read_sectioned_glossary",
    "SELECT p.p_partkey * 2 + 1 AS id, p.p_name AS term, p.p_brand AS value, h.p_type AS category FROM part p JOIN part h ON h.p_partkey = p.p_partkey // 50 * 50",
)
def _(spark, sf):
    return SG.sectioned(_glossary_lines(spark, sf))


@query("read_dictionary", "SELECT p_name AS term, max_by(p_brand, p_partkey) AS value FROM part WHERE length(p_name) >= 8 GROUP BY p_name")
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_name").alias("term"), F.concat("p_brand", F.lit(" ")).alias("value"), F.col("p_partkey").alias("line_no")
    )
    return SG.dictionary_rows(rows, min_len=8)


@query(
    "write_glossary",
    with_ctes(B.GLOSSARY, "c AS (SELECT category, row_number() OVER (ORDER BY category) AS category_no FROM (SELECT DISTINCT category FROM glossary))",
              body="SELECT CAST(category_no AS INTEGER) AS category_no, category, term AS korean, value AS english FROM glossary JOIN c USING (category)"),
)
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/glossary-{uuid.uuid4().hex}"
    SG.write_glossary(B.glossary(spark, sf), path)
    return spark.read.option("header", True).csv(path).select("category_no", "category", "korean", "english")


@query(
    "append_segments",
    with_ctes(B.EV, "st AS (SELECT session_id, min(ts_ms) AS s FROM ev WHERE session_id % 4 <> 0 GROUP BY ALL)",
              body="""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) - 1 AS seq, round((ts_ms - s) / 1000.0::DOUBLE, 3) AS t_offset, event_type AS original
FROM ev JOIN st USING (session_id)"""),
)
def _(spark, sf):
    from ..streaming import jobs

    e = jobs.read_table_stream(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id",
        F.col("event_type").alias("original"), F.upper("event_type").alias("translated"), F.col("ts").cast("timestamp").alias("ts"),
    )
    active = B.ev(spark, sf).where("session_id % 4 <> 0").groupBy("session_id").agg(F.min("ts_ms").alias("started_ms"))
    path = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    ending = jobs.Ending(spark)
    how = {"held_by": "ts", "held": {"stretch": "5 days", "idle": "3650 days"}, "ending": ending, "late": "3650 days"}
    for last in (False, True):
        jobs.append_segments(e, active, path, order=("ts_ms", "event_id"), **how).awaitTermination()
        if not last:
            ending.announce()
    logs = ST.read_segment_logs(spark, f"{path}/segments")
    return logs.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), "t_offset", "original")
