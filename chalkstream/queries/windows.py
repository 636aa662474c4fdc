"""Aggregate, window, fold, ranking and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.generate import rows_of
from ..operators import aggregates as A
from ..operators import gates as G
from ..operators import ranking as R
from ..operators import sets as S
from ..operators import terms as TM
from ..operators import windows as Wn
from ..session import table
from . import base as B
from .base import query, with_ctes
from .gates import ACCENTS
from .joins import LIFE, _lifecycle
from .transcripts import CUES

# ------------------------------------------------------------------------------------- aggregates


@query(
    "category_counts",
    with_ctes(B.GLOSSARY, body="""SELECT category, count(*) AS entries, min(id) AS first_id,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM glossary GROUP BY category"""),
)
def _(spark, sf):
    return A.category_counts(B.glossary(spark, sf))


@query(
    "text_layer_stats",
    with_ctes(B.LIBRARY, f"""b AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, count(*) AS n,
    count(*) FILTER (regexp_matches(p_name, '[xyz]')) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY ALL),
pg AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem),
d AS (SELECT doc_id, count(*) AS total_pages, count(n) AS pages_with_text, CAST(coalesce(sum(n), 0) AS BIGINT) AS text_blocks,
  CAST(coalesce(sum(s), 0) AS BIGINT) AS script_blocks, count(n)::DOUBLE / count(*) AS c FROM pg LEFT JOIN b USING (doc_id, page) GROUP BY doc_id)""",
              body="""SELECT doc_id, total_pages, pages_with_text, text_blocks, script_blocks, round(c, 6) AS coverage,
  CASE WHEN c >= 0.8::DOUBLE THEN 'pdf_layer' WHEN c >= 0.3::DOUBLE THEN 'hybrid' ELSE 'ocr' END AS recommendation FROM d"""),
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_partkey", "l_returnflag"
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    out = A.text_layer_stats(
        li.where("l_returnflag <> 'N'").join(part, "l_partkey"), li.select("doc_id", "page"), script="xyz", rows=2 * li.count()
    )
    return out.withColumn("coverage", F.round("coverage", 6)).drop("coverage_rounded")


@query(
    "route_pages",
    with_ctes(B.REGIONS, """p AS (SELECT page, count(*) FILTER (color <> 0) AS text_blocks,
  coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (color = 0), 0) / 60000 AS share FROM regions GROUP BY page)""",
              body="""SELECT page, text_blocks, round(share, 6) AS image_share,
  CASE WHEN text_blocks < 2 THEN 'ocr' WHEN share >= 0.1::DOUBLE THEN 'layer+ocr' ELSE 'layer' END AS route FROM p"""),
)
def _(spark, sf):
    r = B.regions(spark, sf).withColumns(
        {"kind": F.when(F.col("color") == 0, "image").otherwise("text"), "page_width": F.lit(300.0), "page_height": F.lit(200.0)}
    )
    return A.route_pages(r, ["page"]).withColumn("image_share", F.round("image_share", 6))


@query(
    "paragraph_agg",
    with_ctes(B.REGIONS, body="""SELECT page, block_idx AS block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_lines,
  string_agg(text, ' ' ORDER BY y0, x0, pos) AS text, arg_min(size, (y0, x0, pos)) AS size,
  CASE WHEN count(*) > 1 THEN CASE WHEN arg_min(has_bullet, (y0, x0, pos)) THEN 'bullet' ELSE 'body' END ELSE 'line' END AS role,
  string_agg(color::VARCHAR, ',' ORDER BY y0, x0, pos) AS line_colors, count(DISTINCT color) > 1 AS has_multi_color
FROM regions GROUP BY page, block_idx"""),
)
def _(spark, sf):
    r = B.regions(spark, sf).withColumns(
        {"is_bullet": F.col("has_bullet"), "role": F.lit("line"), "font": F.lit("sans"), "block": F.col("block_idx")}
    )
    out = A.paragraph_agg(r, ["page", "block"], ["y0", "x0", "pos"])
    return out.withColumn("line_colors", F.array_join(F.col("line_colors").cast("array<string>"), ",")).drop(
        "font", "color", "line_texts"
    )


@query(
    "repeated_words",
    r"""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{3,}') AS l FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(i) AS f FROM w GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS rank FROM c) WHERE rank <= 20""",
)
def _(spark, sf):
    d = B.documents(spark, sf).select("doc_id", "text", F.lit(0).alias("pos"))
    return A.repeated_words(d, "doc_id", pattern="[a-z]{3,}")


@query(
    "outcome_counts",
    """SELECT l_orderkey AS page, count(*) FILTER (l_returnflag = 'A') AS replaced, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS review_needed,
  count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS skipped_invalid, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) AS total
FROM lineitem GROUP BY l_orderkey""",
)
def _(spark, sf):
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        F.when(rf == "A", "replaced").when((rf == "N") & (ls == "O"), "review_needed").when(rf == "N", "skipped_invalid").otherwise("error").alias("status"),
    )
    return A.outcome_counts(li, "page")


RMS = "sqrt(list_sum(list_transform(samples, lambda x: x * x)) / 16)"


@query(
    "frame_levels",
    with_ctes(B.FRAMES, f"l AS (SELECT vec_id, frame_no, {RMS} AS rms FROM frames)", "m AS (SELECT *, 20 * log10(greatest(rms, 1e-10)) AS db FROM l)",
              body="SELECT vec_id, frame_no, round(rms, 6) AS rms, round(db, 6) AS db, db BETWEEN -20 AND -15 AS in_target, db >= -6 AS peak_warning FROM m"),
)
def _(spark, sf):
    out = A.frame_levels(B.frames(spark, sf))
    return out.select("vec_id", "frame_no", F.round("rms", 6).alias("rms"), F.round("db", 6).alias("db"), "in_target", "peak_warning")


@query(
    "latency_breakdown",
    with_ctes(B.EV, """c AS (SELECT session_id, CAST(floor(value * 20) AS BIGINT) AS asr_ms, k * 30 AS nmt_ms, CASE WHEN k % 2 = 0 THEN k * 10 END AS tts_ms,
   k % 3 AS sub_seq, ts_ms AS input_ms, ts_ms + k * 50 AS output_ms FROM ev),
t AS (SELECT *, asr_ms + nmt_ms + coalesce(tts_ms, 0) AS total_ms FROM c)""",
              body="""SELECT session_id, count(*) AS captions, round(avg(asr_ms), 6) AS avg_asr_ms, round(avg(nmt_ms), 6) AS avg_nmt_ms, round(avg(tts_ms), 6) AS avg_tts_ms,
  round(avg(total_ms), 6) AS avg_total_ms, round(avg(output_ms - input_ms) FILTER (sub_seq = 0), 6) AS avg_first_caption_ms,
  count(*) FILTER (total_ms < 3000) AS fast, count(*) FILTER (total_ms >= 3000 AND total_ms < 6000) AS medium, count(*) FILTER (total_ms >= 6000) AS slow
FROM t GROUP BY session_id"""),
)
def _(spark, sf):
    k = F.col("k")
    c = B.ev(spark, sf).withColumns(
        {
            "asr_ms": F.floor(F.col("value") * 20), "nmt_ms": k * 30, "tts_ms": F.when(k % 2 == 0, k * 10),
            "sub_seq": k % 3, "input_ms": F.col("ts_ms"), "output_ms": F.col("ts_ms") + k * 50,
        }
    )
    out = A.latency_breakdown(c, "session_id")
    return out.withColumns({n: F.round(n, 6) for n in out.columns if n.startswith("avg_")})


@query(
    "session_summary",
    with_ctes(B.SEGMENTS, body="""SELECT session_id, count(*) FILTER (ok) AS segments, count(*) FILTER (NOT ok) AS blocked,
  min(t_offset) FILTER (ok) AS first_offset, max(t_offset) FILTER (ok) AS last_offset
FROM (SELECT *, role <> 'system' AND length(original) <= 200 AS ok FROM segments) GROUP BY session_id"""),
)
def _(spark, sf):
    gated = G.gate(
        B.segments(spark, sf), [("system", F.col("role") == "system"), ("long", F.length("original") > 200)]
    )
    return A.session_summary(gated, "session_id")


@query(
    "audience_size",
    with_ctes(B.EV, body="""SELECT event_id, session_id % 10 AS room, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)
  OVER (PARTITION BY session_id % 10 ORDER BY ts_ms, event_id) AS BIGINT) AS audience FROM ev"""),
)
def _(spark, sf):
    e = B.ev(spark, sf)
    t = F.col("event_type")
    moves = e.select(
        "event_id", (F.col("session_id") % 10).alias("room"), "ts_ms",
        F.when(t == "signup", "join").when(t == "error", "leave").otherwise("stay").alias("type"),
    )
    return Wn.audience_size(moves, "room", ["ts_ms", "event_id"]).select("event_id", "room", "audience")


PARSED = """q AS (SELECT c_custkey AS chunk, 5 + c_custkey % 10 AS total_lines FROM customer),
r AS (SELECT DISTINCT user_id AS chunk, CAST(json_extract_string(props, '$.k') AS BIGINT) % 18 AS line_no FROM events)"""


def _parsed(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("chunk"), (F.col("c_custkey") % 10 + 5).alias("total_lines"))
    r = B.ev(spark, sf).select(F.col("session_id").alias("chunk"), (F.col("k") % 18).alias("line_no"))
    return q, r


@query(
    "response_coverage",
    with_ctes(PARSED, "j AS (SELECT chunk, count(*) FILTER (line_no BETWEEN 1 AND total_lines) AS matched, count(*) FILTER (NOT line_no BETWEEN 1 AND total_lines) AS extra FROM r JOIN q USING (chunk) GROUP BY chunk)",
              body="""SELECT chunk, total_lines, coalesce(matched, 0) AS matched, coalesce(extra, 0) AS extra, total_lines - coalesce(matched, 0) AS missing,
  coalesce(matched, 0) >= total_lines * 0.8::DOUBLE AS accepted FROM q LEFT JOIN j USING (chunk)"""),
)
def _(spark, sf):
    q, r = _parsed(spark, sf)
    return A.response_coverage(r, q, "chunk")


@query("any_in_state", with_ctes(B.LIBRARY, body="SELECT bool_or(status IN ('pending', 'processing')) AS busy FROM library"))
def _(spark, sf):
    return A.any_in_state(B.library(spark, sf))


@query(
    "layout_summary",
    with_ctes(B.REGIONS, body="SELECT page, count(*) AS analysed, count(*) FILTER (size <= 12 AND length(text) < 20) AS on_image FROM regions GROUP BY page"),
)
def _(spark, sf):
    r = G.layout_defaults(B.regions(spark, sf).withColumns({"role": F.lit("body"), "prefix": F.lit("")}))
    return A.layout_summary(r, "page")


@query(
    "collect_corpus",
    with_ctes(B.LINES, body="SELECT doc_id, line_no, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS corpus_no FROM lines WHERE text <> ''"),
)
def _(spark, sf):
    return A.collect_corpus(B.lines(spark, sf), "doc_id", ["line_no"]).select("doc_id", "line_no", "text", "corpus_no")


# ------------------------------------------------------------------------------------- windows


@query("cue_times", with_ctes(B.SEGMENTS, CUES, body="SELECT session_id, seq, cue_no, t_offset, t_end FROM cues"))
def _(spark, sf):
    return Wn.cue_times(B.segments(spark, sf)).select("session_id", "seq", "cue_no", "t_offset", "t_end")


NEEDED = """nd AS (SELECT *, list(needed) OVER w AS win, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS rn
  FROM (SELECT session_id, ts_ms, event_id, value * 100 AS needed FROM ev)
  WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
tg AS (SELECT session_id, ts_ms, event_id, rn, CASE WHEN len(win) >= 3 THEN greatest(1000.0::DOUBLE, least(20000.0::DOUBLE,
  list_sort(win)[CAST(floor((len(win) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] + greatest(300.0::DOUBLE, list_stddev_pop(win) * 1.5::DOUBLE))) END AS target FROM nd)"""


def _needed(spark, sf):
    return B.ev(spark, sf).select("session_id", "ts_ms", "event_id", (F.col("value") * 100).alias("needed_ms"))


ORDER = ["ts_ms", "event_id"]


@query("delay_target", with_ctes(B.EV, NEEDED, body="SELECT event_id, round(target, 4) AS target_ms FROM tg"))
def _(spark, sf):
    out = Wn.delay_target(_needed(spark, sf), "session_id", ORDER)
    return out.select("event_id", F.round("target_ms", 4).alias("target_ms"))


def recursive(ctes: str, step: str) -> str:
    return "WITH RECURSIVE " + ctes + step


@query(
    "adaptive_delay",
    recursive(B.EV + ",\n" + NEEDED, """, f AS (
  SELECT session_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, 2000.0::DOUBLE AS d FROM (SELECT DISTINCT session_id FROM tg)
  UNION ALL
  SELECT t.session_id, t.rn, t.event_id, CASE WHEN t.target IS NULL THEN f.d
    ELSE greatest(1000.0::DOUBLE, least(20000.0::DOUBLE, CASE WHEN t.target >= f.d THEN t.target ELSE f.d + (t.target - f.d) * 0.25::DOUBLE END)) END
  FROM f JOIN tg t ON t.session_id = f.session_id AND t.rn = f.rn + 1)
SELECT event_id, round(d, 4) AS delay_ms FROM f WHERE rn > 0"""),
)
def _(spark, sf):
    t = Wn.delay_target(_needed(spark, sf), "session_id", ORDER)
    return Wn.adaptive_delay(t, "session_id", ORDER).select("event_id", F.round("delay_ms", 4).alias("delay_ms"))


@query(
    "clock_offset",
    recursive(B.EV, """, o AS (SELECT session_id, event_id, value * 30 - 1500 AS x, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS rn
  FROM ev WHERE abs(value * 30 - 1500) <= 5000),
f AS (SELECT session_id, event_id, rn, x AS v FROM o WHERE rn = 1 UNION ALL
  SELECT o.session_id, o.event_id, o.rn, f.v * (1 - CASE WHEN o.rn <= 5 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END) + o.x * CASE WHEN o.rn <= 5 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END
  FROM f JOIN o ON o.session_id = f.session_id AND o.rn = f.rn + 1)
SELECT event_id, round(v, 5) AS offset_ms FROM f"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).withColumn("observed_ms", F.col("value") * 30 - 1500)
    out = Wn.clock_offset(e, "session_id", ORDER)
    return out.select("event_id", F.round("offset_ms", 5).alias("offset_ms"))


# Strokes: the events of ten users together, clocks sped up by 2000, so that gaps below a second occur.
VIS = """v AS (SELECT session_id % 10 AS s, event_id, ts_ms // 2000 AS t, floor(value) AS off, (k % 5) * 400 AS dl,
  row_number() OVER (PARTITION BY session_id % 10 ORDER BY ts_ms, event_id) AS rn FROM ev)"""


@query(
    "schedule_visual",
    recursive(B.EV + ",\n" + VIS, """, f AS (
  SELECT s, 0::BIGINT AS rn, -1::BIGINT AS event_id, 0::BIGINT AS t, 0.0::DOUBLE AS w FROM (SELECT DISTINCT s FROM v)
  UNION ALL
  SELECT v.s, v.rn, v.event_id, v.t, CASE WHEN f.t > 0 AND v.t - f.t > 0 AND v.t - f.t < 1000 THEN f.w + (v.t - f.t) ELSE greatest(v.t + v.off + v.dl, f.w) END
  FROM f JOIN v ON v.s = f.s AND v.rn = f.rn + 1)
SELECT event_id, round(w, 3) AS show_ms FROM f WHERE rn > 0"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).select(
        (F.col("session_id") % 10).alias("s"), "event_id", F.floor(F.col("ts_ms") / 2000).alias("t"),
        F.floor("value").cast("double").alias("offset_ms"), ((F.col("k") % 5) * 400).alias("delay_ms"),
    )
    out = Wn.schedule_visual(e, "s", ["t", "event_id"], ts="t")
    return out.select("event_id", F.round("show_ms", 3).alias("show_ms"))


SENT = """se AS (SELECT session_id, event_id, ts_ms AS st, ts_ms + k * 200 AS nw, floor(value) AS off, 1000 + (k % 7) * 300 AS dl,
  row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS rn FROM ev)"""


@query(
    "schedule_sentences",
    recursive(B.EV + ",\n" + SENT, """, f AS (
  SELECT session_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, 0.0::DOUBLE AS w, 0.0::DOUBLE AS shown, FALSE AS dropped FROM (SELECT DISTINCT session_id FROM se)
  UNION ALL
  SELECT e.session_id, e.rn, e.event_id, CASE WHEN greatest(e.st + e.off + e.dl, f.w) < e.nw - e.dl - 10000 THEN f.w ELSE greatest(e.st + e.off + e.dl, f.w) END,
    greatest(e.st + e.off + e.dl, f.w), greatest(e.st + e.off + e.dl, f.w) < e.nw - e.dl - 10000
  FROM f JOIN se e ON e.session_id = f.session_id AND e.rn = f.rn + 1)
SELECT event_id, round(shown, 3) AS show_ms, dropped FROM f WHERE rn > 0"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).select(
        "session_id", "event_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.col("k") * 200).alias("now_ms"),
        F.floor("value").cast("double").alias("offset_ms"), ((F.col("k") % 7) * 300 + 1000).alias("delay_ms"),
    )
    out = Wn.schedule_sentences(e, "session_id", ["start_ms", "event_id"])
    return out.select("event_id", F.round("show_ms", 3).alias("show_ms"), "dropped")


ACT = """a AS (SELECT session_id, event_id, value, value > 20 AS loud, row_number() OVER w AS no,
   coalesce(lag(value > 20) OVER w, FALSE) AS was, coalesce(lead(value > 20) OVER w, FALSE) AS nxt
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id)),
b AS (SELECT *, sum(CASE WHEN loud AND NOT was THEN 1 ELSE 0 END) OVER w AS seg,
   max(CASE WHEN loud AND NOT was THEN no END) OVER w AS f FROM a WINDOW w AS (PARTITION BY session_id ORDER BY no)),
act AS (SELECT session_id, event_id, value, CAST(seg AS BIGINT) AS segment, (no - f) * 200 // 1500 AS part FROM b WHERE loud OR was
  UNION ALL SELECT session_id, event_id, value, CAST(seg + 1 AS BIGINT), 0 FROM b WHERE NOT loud AND nxt)"""


def _active(spark, sf):
    e = B.ev(spark, sf).withColumn("rms", F.col("value"))
    return Wn.activity_segments(e, "session_id", ORDER, threshold=20.0)


@query("activity_segments", with_ctes(B.EV, ACT, body="SELECT session_id, event_id, segment, part FROM act"))
def _(spark, sf):
    return _active(spark, sf).select("session_id", "event_id", "segment", "part")


@query(
    "segment_chunks",
    with_ctes(B.EV, ACT, body="""SELECT session_id, segment, part, count(*) AS frames, round(sqrt(avg(value * value)), 5) AS chunk_rms FROM act
GROUP BY ALL HAVING count(*) * 200 >= 300 AND sqrt(avg(value * value)) >= 30"""),
)
def _(spark, sf):
    out = Wn.segment_chunks(_active(spark, sf), "session_id", min_rms=30.0)
    return out.withColumn("chunk_rms", F.round("chunk_rms", 5))


# Hypotheses: a turn's sentences are prefixes of the words said so far, rewritten now and then.
HYP = r"""h AS (SELECT conv_id AS utt_id, turn AS pass_no, string_split(text, chr(10)) AS cur, turn = max(turn) OVER (PARTITION BY conv_id) AS is_final FROM conversations),
hh AS (SELECT utt_id, pass_no, is_final, [CASE WHEN pass_no % 4 = 3 THEN 'b' ELSE 'a' END, 'x' || (pass_no // 2), 'y' || (pass_no // 3), 'z' || len(cur)][1:1 + pass_no % 4 + 1] AS s FROM h),
l AS (SELECT *, lag(s) OVER (PARTITION BY utt_id ORDER BY pass_no) AS p FROM hh),
c AS (SELECT *, CASE WHEN is_final THEN len(s) WHEN p IS NULL THEN 0 ELSE
   coalesce(list_min(list_filter(range(1, least(len(s), len(p)) + 1), lambda i: s[i] <> p[i])) - 1, least(len(s), len(p))) END AS reach FROM l),
g AS (SELECT *, coalesce(max(reach) OVER (PARTITION BY utt_id ORDER BY pass_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM c)"""


@query(
    "stable_commits",
    with_ctes(HYP, body="""SELECT utt_id, pass_no, CAST(done AS INTEGER) AS first_sub_seq, greatest(reach, done) AS committed_total,
  CASE WHEN reach > done THEN array_to_string(s[done + 1:reach], '|') ELSE '' END AS committed FROM g"""),
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    n = F.col("turn")
    text = F.array(
        F.when(n % 4 == 3, "b").otherwise("a"), F.concat(F.lit("x"), F.floor(n / 2).cast("string")),
        F.concat(F.lit("y"), F.floor(n / 3).cast("string")), F.concat(F.lit("z"), F.size(F.split("text", "\n")).cast("string")),
    )
    h = c.join(last, "conv_id").select(
        F.col("conv_id").alias("utt_id"), n.alias("pass_no"), (n == F.col("_last")).alias("is_final"),
        F.slice(text, F.lit(1), (n % 4 + 2).cast("int")).alias("sentences"),
    )
    out = Wn.stable_commits(h)
    return out.select("utt_id", "pass_no", "first_sub_seq", "committed_total", F.array_join("committed", "|").alias("committed"))


@query("event_sequence", with_ctes(B.EV, body="SELECT event_id, row_number() OVER (ORDER BY ts_ms, event_id) AS event_seq FROM ev"))
def _(spark, sf):
    return Wn.event_sequence(B.ev(spark, sf), ORDER).select("event_id", "event_seq")


@query(
    "sequence_gaps",
    with_ctes(B.EV, "g AS (SELECT event_id, k, lag(k) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS p FROM ev)",
              body="SELECT event_id, coalesce(greatest(k - p - 1, 0), 0) AS missing, coalesce(k <= p, FALSE) AS duplicate FROM g"),
)
def _(spark, sf):
    return Wn.sequence_gaps(B.ev(spark, sf), "session_id", ORDER, "k").select("event_id", "missing", "duplicate")


def presence_from(events):
    return events.withColumns(
        {
            "page": F.when(F.col("event_type") == "view", F.col("k")), "last_type": F.col("event_type"),
            "slide": F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), (F.col("k") % 5).cast("string"))),
        }
    )


@query(
    "latest_per_key",
    with_ctes(B.EV, body="""SELECT session_id, max_by(k, (ts_ms, event_id)) FILTER (event_type = 'view') AS page,
  max_by(event_type, (ts_ms, event_id)) AS last_type, max_by('s' || (k % 5), (ts_ms, event_id)) FILTER (event_type = 'signup') AS slide FROM ev GROUP BY session_id"""),
)
def _(spark, sf):
    e = presence_from(B.ev(spark, sf))
    return Wn.latest_per_key(e, ["session_id"], ["page", "last_type", "slide"], ORDER)


@query(
    "every_nth",
    with_ctes(B.EV, body="""SELECT event_id, event_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms, event_id) AS no FROM ev)
WHERE event_type NOT IN ('click', 'view') OR no % 10 = 0"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).withColumn("type", F.col("event_type"))
    return Wn.every_nth(e, ["click", "view"], ORDER).select("event_id", "type")


# Board events: slide per user group, page by k; purchase clears a board, signup starts a lecture.
DRAW = """dr AS (SELECT event_id AS seq, session_id % 30 AS slide, k % 3 AS page,
  CASE event_type WHEN 'signup' THEN CASE WHEN k % 9 = 0 THEN 'lecture_start' ELSE 'draw_begin' END
    WHEN 'purchase' THEN CASE WHEN k % 6 = 0 THEN 'draw_clear' ELSE 'draw_end' END WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 'draw_erase' ELSE 'draw_end' END ELSE 'draw_point' END AS type,
  'i' || (k % 2) AS id, CASE WHEN k % 5 = 0 THEN 'rect' ELSE 'pencil' END AS tool, value AS x FROM ev)"""


def _draws(spark, sf):
    return draws_from(B.ev(spark, sf))


def _time_of(events):
    """The event time of a stream."""
    return [c for c in ("ts",) if events.isStreaming and c in events.columns]


def draws_from(events):
    k, t = F.col("k"), F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq"), (F.col("session_id") % 30).alias("slide"), (k % 3).alias("page"),
        F.when(t == "signup", F.when(k % 9 == 0, "lecture_start").otherwise("draw_begin"))
        .when(t == "purchase", F.when(k % 6 == 0, "draw_clear").otherwise("draw_end"))
        .when(t == "error", F.when(k % 4 == 0, "draw_erase").otherwise("draw_end")).otherwise("draw_point").alias("type"),
        F.concat(F.lit("i"), (k % 2).cast("string")).alias("id"), F.when(k % 5 == 0, "rect").otherwise("pencil").alias("tool"),
        F.lit("#000").alias("color"), F.col("value").alias("x"), F.col("value").alias("y"), *_time_of(events),
    )


CLEARED = """kept AS (SELECT d.seq, d.slide, d.page, d.type FROM dr d
  LEFT JOIN (SELECT slide, page, max(seq) AS c FROM dr WHERE type = 'draw_clear' GROUP BY ALL) USING (slide, page)
  LEFT JOIN (SELECT slide, max(seq) AS s FROM dr WHERE type = 'lecture_start' GROUP BY ALL) USING (slide)
  WHERE type NOT IN ('draw_clear', 'lecture_start') AND seq > greatest(coalesce(c, -1), coalesce(s, -1)))"""


@query("after_last_clear", with_ctes(B.EV, DRAW, CLEARED, body="SELECT * FROM kept"))
def _(spark, sf):
    return Wn.after_last_clear(_draws(spark, sf), ["slide", "page"]).select("seq", "slide", "page", "type")


@query("drawings_replay", with_ctes(B.EV, DRAW, CLEARED, body="SELECT * FROM kept WHERE slide IN (SELECT DISTINCT label FROM embeddings)"))
def _(spark, sf):
    current = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("slide")).distinct()
    return Wn.drawings_replay(_draws(spark, sf), current, ["slide", "page"]).select("seq", "slide", "page", "type")


@query(
    "assemble_strokes",
    with_ctes(B.EV, DRAW, """m AS (SELECT *, sum(CASE WHEN type IN ('draw_begin', 'draw_clear') THEN 1 ELSE 0 END) OVER (PARTITION BY slide ORDER BY seq) AS n FROM dr),
o AS (SELECT slide, n, min_by(id, seq) AS oid, min_by(tool, seq) AS otool, min_by(page, seq) AS opage, min_by(type, seq) AS otype FROM m WHERE type IN ('draw_begin', 'draw_clear') GROUP BY ALL),
e AS (SELECT slide, n, min(seq) AS z FROM m JOIN o USING (slide, n) WHERE type = 'draw_end' AND id = oid AND otype = 'draw_begin' GROUP BY ALL)""",
              body="""SELECT slide, opage AS page, CASE WHEN otool = 'rect' THEN 'rect' ELSE 'stroke' END AS kind, oid AS id, otool AS tool, count(*) AS points,
  min_by(x, m.seq) AS x_first, max_by(x, m.seq) AS x_last, max(z) AS seq
FROM m JOIN o USING (slide, n) JOIN e USING (slide, n) WHERE type = 'draw_point' AND id = oid AND m.seq < z GROUP BY slide, n, opage, otool, oid
UNION ALL SELECT slide, page, 'erase', id, NULL, 1, x, x, seq FROM dr WHERE type = 'draw_erase'"""),
)
def _(spark, sf):
    out = Wn.assemble_strokes(_draws(spark, sf), ["slide"], ["seq"])
    return out.select("slide", "page", "kind", "id", "tool", "points", "x_first", "x_last", "seq")


@query(
    "stroke_points",
    with_ctes(B.EV, DRAW, "m AS (SELECT *, CAST(sum(CASE WHEN type IN ('draw_begin', 'draw_clear') THEN 1 ELSE 0 END) OVER (PARTITION BY slide ORDER BY seq) AS BIGINT) AS stroke_no FROM dr)",
              body="SELECT slide, seq, stroke_no, row_number() OVER (PARTITION BY slide, stroke_no ORDER BY seq) AS point_no FROM m WHERE type = 'draw_point'"),
)
def _(spark, sf):
    return Wn.stroke_points(_draws(spark, sf), ["slide"], ["seq"]).select("slide", "seq", "stroke_no", "point_no")


@query(
    "attach_stroke_page",
    with_ctes(B.EV, DRAW, body="""SELECT slide, seq, CASE WHEN type IN ('draw_point', 'draw_end') THEN last_value(CASE WHEN type = 'draw_begin' THEN page END IGNORE NULLS) OVER (PARTITION BY slide ORDER BY seq) ELSE page END AS page FROM dr"""),
)
def _(spark, sf):
    d = _draws(spark, sf)
    bare = d.withColumn("page", F.when(~F.col("type").isin("draw_point", "draw_end"), F.col("page")))
    return Wn.attach_stroke_page(bare, ["slide"], ["seq"]).select("slide", "seq", "page")


@query(
    "lecture_sessions",
    with_ctes(B.EV, """lc AS (SELECT session_id, ts_ms, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'disconnect' WHEN 'view' THEN 'reconnect' ELSE 'end' END AS type
  FROM ev WHERE event_type IN ('signup', 'error', 'view') OR (event_type = 'purchase' AND k % 3 = 0)),
a AS (SELECT *, lead(ts_ms) OVER w AS nx, sum(CASE WHEN type = 'start' THEN 1 ELSE 0 END) OVER w AS n FROM lc WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id)),
c AS (SELECT *, CASE WHEN type = 'end' THEN ts_ms WHEN type = 'disconnect' AND coalesce(nx - ts_ms > 21600000, TRUE) THEN ts_ms + 21600000 END AS cl FROM a WHERE n > 0),
s AS (SELECT session_id, n, min(ts_ms) FILTER (type = 'start') AS start_ms, min(cl) AS e, min_by(CASE WHEN type = 'end' THEN 'end' ELSE 'timeout' END, (cl, ts_ms, event_id)) FILTER (cl IS NOT NULL) AS how FROM c GROUP BY ALL),
t AS (SELECT *, lead(start_ms) OVER (PARTITION BY session_id ORDER BY n) AS st FROM s)""",
              body="""SELECT session_id, CAST(n AS BIGINT) AS session_no, start_ms, coalesce(e, st) AS end_ms,
  coalesce(how, CASE WHEN st IS NOT NULL THEN 'stale' END, 'open') AS ended_by FROM t"""),
)
def _(spark, sf):
    t = F.col("event_type")
    e = B.ev(spark, sf).where(t.isin("signup", "error", "view") | ((t == "purchase") & (F.col("k") % 3 == 0)))
    e = e.withColumn("type", F.when(t == "signup", "start").when(t == "error", "disconnect").when(t == "view", "reconnect").otherwise("end"))
    return Wn.lecture_sessions(e, "session_id", ORDER, grace_ms=21_600_000)


@query(
    "pause_durations",
    with_ctes(B.EV, f"""lf AS (SELECT session_id, event_id, ts_ms, k, {LIFE} AS type FROM ev WHERE event_type IN ('signup', 'error')),
p AS (SELECT *, last_value(CASE type WHEN 'pause' THEN ts_ms WHEN 'resume' THEN -1 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM lf)""",
              body="""SELECT event_id, CASE WHEN pt >= 0 THEN greatest(ts_ms - pt, 0) ELSE 0 END AS pause_ms,
  greatest(CASE WHEN pt >= 0 THEN greatest(ts_ms - pt, 0) ELSE 0 END - 20000000, 0) AS remaining_ms FROM p WHERE type = 'resume'"""),
)
def _(spark, sf):
    out = Wn.pause_durations(_lifecycle(spark, sf), "session_id", ORDER)
    left = Wn.pause_remaining(out.withColumn("elapsed_ms", F.lit(20_000_000).cast("long")))
    return left.select("event_id", "pause_ms", "remaining_ms")


@query(
    "suppress_repeats",
    recursive(B.EV, """, sx AS (SELECT session_id, event_id, ts_ms, CASE WHEN k % 3 = 0 THEN 'bye.' ELSE 'thanks' END AS t,
   row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS rn FROM ev WHERE event_type IN ('click', 'view', 'error')),
f AS (SELECT session_id, event_id, rn, t AS lt, ts_ms AS la, FALSE AS suppressed FROM sx WHERE rn = 1
  UNION ALL SELECT s.session_id, s.event_id, s.rn, s.t, CASE WHEN s.t = f.lt AND s.ts_ms - f.la < 100000000 THEN f.la ELSE s.ts_ms END, s.t = f.lt AND s.ts_ms - f.la < 100000000
  FROM f JOIN sx s ON s.session_id = f.session_id AND s.rn = f.rn + 1)
SELECT event_id, suppressed FROM f UNION ALL SELECT event_id, FALSE FROM ev WHERE event_type NOT IN ('click', 'view', 'error')"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).withColumn(
        "text",
        F.when(~F.col("event_type").isin("click", "view", "error"), "a long text that is no courtesy")
        .when(F.col("k") % 3 == 0, "bye.").otherwise("thanks"),
    )
    out = Wn.suppress_repeats(e, "session_id", ORDER, courtesy=r"^(?:bye|thanks)[\s\.!]*$", window_ms=100_000_000)
    return out.select("event_id", "suppressed")


@query(
    "link_quality",
    with_ctes(B.EV, """q AS (SELECT event_id, session_id, k // 34 AS conn, CAST(sum(CAST(floor(value * 10) AS BIGINT)) OVER w AS BIGINT) AS received,
   CAST(sum(CASE WHEN k % 5 = 0 THEN k ELSE 0 END) OVER w AS BIGINT) AS lost, ts_ms FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id)),
l AS (SELECT *, lag(received) OVER w AS r, lag(lost) OVER w AS l, lag(conn) OVER w AS c FROM q WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id)),
d AS (SELECT event_id, greatest(received - CASE WHEN coalesce(c = conn, FALSE) THEN r ELSE 0 END, 0) AS delta_received, greatest(lost - CASE WHEN coalesce(c = conn, FALSE) THEN l ELSE 0 END, 0) AS delta_lost FROM l),
p AS (SELECT *, CASE WHEN delta_received + delta_lost > 0 THEN delta_lost::DOUBLE / (delta_received + delta_lost) * 100 ELSE 0 END AS loss FROM d)""",
              body="""SELECT event_id, delta_received, delta_lost, round(loss, 6) AS loss_percent,
  CASE WHEN delta_received = 0 THEN 'offline' WHEN loss < 1 THEN 'good' WHEN loss < 5 THEN 'fair' ELSE 'poor' END AS quality FROM p"""),
)
def _(spark, sf):
    from ..plans.scans import RunSum, with_scans

    k = F.col("k")
    e = with_scans(
        B.ev(spark, sf).withColumn("conn", F.floor(k / 34)), ["session_id"], ORDER,
        {"received": RunSum(F.floor(F.col("value") * 10)), "lost": RunSum(F.when(k % 5 == 0, k).otherwise(0))},
    )
    out = Wn.link_quality(e, "session_id", "conn", ORDER)
    return out.select("event_id", "delta_received", "delta_lost", F.round("loss_percent", 6).alias("loss_percent"), "quality")


EMA = """pe AS (SELECT session_id, event_id, greatest(value, 0) AS d, CASE WHEN event_type IN ('view', 'click') THEN 'ocr' WHEN event_type = 'error' THEN 'translate' ELSE 'bundling' END AS stage, k FROM ev),
pn AS (SELECT pe.*, row_number() OVER (PARTITION BY session_id, stage ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY session_id, stage) AS total FROM pe),
f AS (SELECT session_id, stage, event_id, rn, total, k, 0.5::DOUBLE * CASE stage WHEN 'ocr' THEN 15.0::DOUBLE WHEN 'translate' THEN 50.0::DOUBLE ELSE d END + 0.5::DOUBLE * d AS a FROM pn WHERE rn = 1
  UNION ALL SELECT p.session_id, p.stage, p.event_id, p.rn, p.total, p.k, 0.75::DOUBLE * f.a + 0.25::DOUBLE * p.d FROM f JOIN pn p ON p.session_id = f.session_id AND p.stage = f.stage AND p.rn = f.rn + 1)"""


def pages_from(events):
    t = F.col("event_type")
    return events.select(
        "session_id", "event_id", F.col("value").alias("seconds"), "k",
        F.when(t.isin("view", "click"), "ocr").when(t == "error", "translate").otherwise("bundling").alias("stage"), *_time_of(events),
    )


def _ema(spark, sf):
    return Wn.page_ema(pages_from(B.ev(spark, sf)), ["session_id", "stage"], ["event_id"])


@query("page_ema", recursive(B.EV + ",\n" + EMA, " SELECT event_id, round(a + 1e-9::DOUBLE, 6) AS avg_seconds FROM f"))
def _(spark, sf):
    # Averages of two-decimal values often end on a tie; both sides round just above it.
    return _ema(spark, sf).select("event_id", F.round(F.col("avg_seconds") + 1e-9, 6).alias("avg_seconds"))


@query(
    "stage_eta",
    recursive(B.EV + ",\n" + EMA, """, e AS (SELECT *, greatest(total - rn, 0) AS lft, CASE WHEN a > 0 THEN a ELSE 50 END AS per, k / 10.0::DOUBLE AS el FROM f),
o AS (SELECT *, CASE WHEN lft > 0 THEN (per - el) + per * (lft - 1) ELSE 0 END AS own FROM e)
SELECT event_id, round(greatest(CASE stage WHEN 'ocr' THEN own + (total * 50.0::DOUBLE + 3) WHEN 'translate' THEN own ELSE 3.0::DOUBLE - el END, 0) + 1e-8::DOUBLE, 5) AS eta_seconds FROM o"""),
)
def _(spark, sf):
    from ..plans.scans import RowNumber, Total, with_scans

    e = with_scans(
        _ema(spark, sf), ["session_id", "stage"], ["event_id"], {"stage_current": RowNumber(), "stage_total": Total()}
    ).withColumn("elapsed", F.col("k") / 10.0)
    return Wn.stage_eta(e).select("event_id", F.round(F.col("eta_seconds") + 1e-8, 5).alias("eta_seconds"))


@query(
    "pack_chunks",
    recursive("""bl AS (SELECT o_custkey AS doc, l_orderkey AS page, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
bn AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS rn FROM bl),
f AS (SELECT doc, page, n, rn, 0::BIGINT AS chunk_no, n AS fill FROM bn WHERE rn = 1
  UNION ALL SELECT b.doc, b.page, b.n, b.rn,
    f.chunk_no + CASE WHEN f.fill >= 15 OR f.fill + b.n > 15 THEN 1 ELSE 0 END, CASE WHEN f.fill >= 15 OR f.fill + b.n > 15 THEN b.n ELSE f.fill + b.n END
  FROM f JOIN bn b ON b.doc = f.doc AND b.rn = f.rn + 1)""", """
SELECT doc, page, chunk_no, count(*) AS blocks FROM f JOIN lineitem ON l_orderkey = page GROUP BY ALL"""),
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("doc"))
    packed = Wn.pack_chunks(li.join(o, "page"), ["doc"])
    return packed.groupBy("doc", "page", "chunk_no").agg(F.count(F.lit(1)).alias("blocks"))


@query(
    "peak_hold",
    recursive(B.EV, """, lv AS (SELECT session_id, event_id, value - 60 AS db, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS rn FROM ev),
f AS (SELECT session_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, -60.0::DOUBLE AS p, 0::BIGINT AS idle FROM (SELECT DISTINCT session_id FROM lv)
  UNION ALL SELECT l.session_id, l.rn, l.event_id, CASE WHEN l.db > f.p THEN l.db WHEN f.idle + 1 > 5 THEN f.p - 0.7::DOUBLE ELSE f.p END,
    CASE WHEN l.db > f.p THEN 0 ELSE f.idle + 1 END FROM f JOIN lv l ON l.session_id = f.session_id AND l.rn = f.rn + 1)
SELECT event_id, round(p, 6) AS peak_db FROM f WHERE rn > 0"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).select("session_id", "event_id", (F.col("value") - 60).alias("db"))
    return Wn.peak_hold(e, ["session_id"], ["event_id"], hold=5).select("event_id", F.round("peak_db", 6).alias("peak_db"))


@query(
    "frame_batches",
    recursive(B.EV, """, fr AS (SELECT session_id, event_id, value, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS rn FROM ev),
f AS (SELECT session_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, 0::BIGINT AS since, 0::BIGINT AS fired, FALSE AS fires FROM (SELECT DISTINCT session_id FROM fr)
  UNION ALL SELECT r.session_id, r.rn, r.event_id, CASE WHEN f.since + 1 >= 3 OR (f.since + 1 >= 2 AND r.value < 20) THEN 0 ELSE f.since + 1 END,
   f.fired + CASE WHEN f.since + 1 >= 3 OR (f.since + 1 >= 2 AND r.value < 20) THEN 1 ELSE 0 END, f.since + 1 >= 3 OR (f.since + 1 >= 2 AND r.value < 20)
  FROM f JOIN fr r ON r.session_id = f.session_id AND r.rn = f.rn + 1)
SELECT event_id, fires, fired - CASE WHEN fires THEN 1 ELSE 0 END + 1 AS batch_no FROM f WHERE rn > 0"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).select("session_id", "event_id", "value")
    out = Wn.frame_batches(e, ["session_id"], ["event_id"], level="value", quiet=20.0)
    return out.select("event_id", "fires", "batch_no")


# ------------------------------------------------------------------------------------- ranking


@query("sort_library", with_ctes(B.LIBRARY, body="SELECT slide_id, filename, uploaded_at, file_size FROM library"))
def _(spark, sf):
    return R.sort_library(B.library(spark, sf), "name").select("slide_id", "filename", "uploaded_at", "file_size")


@query(
    "reading_order",
    with_ctes(B.REGIONS, body="SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY y0, x0, pos) AS position FROM regions"),
)
def _(spark, sf):
    return R.reading_order(B.regions(spark, sf), ["page"], ["pos"]).select("page", "pos", "position")


@query(
    "last_n",
    with_ctes(B.EV, body="""SELECT event_id, session_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, event_id DESC) AS recency FROM ev) WHERE recency <= 51"""),
)
def _(spark, sf):
    return R.last_n(B.ev(spark, sf), "session_id", ORDER).select("event_id", "session_id", "recency")


@query(
    "hint_terms",
    r"""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{7,}') AS l FROM documents)),
f AS (SELECT doc_id, t, min(i) AS i FROM w WHERE length(t) <= 40 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f),
h AS (SELECT doc_id, string_agg(t, ', ' ORDER BY n) AS hint FROM r WHERE n <= 32 GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(hint) > 280 THEN trim(regexp_replace(substr(hint, 1, 280), '^(.*),.*$', '\1')) ELSE hint END AS hint FROM h""",
)
def _(spark, sf):
    found = F.regexp_extract_all("text", F.lit("([a-z]{7,})"), F.lit(1))
    d = rows_of(B.documents(spark, sf), found, "pos", "term", ["doc_id"])
    return TM.hint_terms(d, ["doc_id"], "pos")


# ------------------------------------------------------------------------------------- sets


@query(
    "union_blocks",
    with_ctes(B.LINES, body=f"""SELECT 'layer' AS source, doc_id, text FROM lines WHERE regexp_matches(text, '[{ACCENTS}]')
UNION ALL SELECT 'ocr', conv_id, text FROM conversations WHERE regexp_matches(text, '[{ACCENTS}]')"""),
)
def _(spark, sf):
    layer = B.lines(spark, sf).select(F.lit("layer").alias("source"), "doc_id", "text")
    ocr = table(spark, sf, "conversations").select(F.lit("ocr").alias("source"), F.col("conv_id").alias("doc_id"), "text")
    return S.union_blocks(layer, ocr, ACCENTS)


@query(
    "union_pages",
    """SELECT l_orderkey AS slide_id, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'R'
UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("page"), "l_returnflag", "l_linestatus"
    )
    return S.union_pages(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), ["slide_id", "page"])


@query(
    "missing_ids",
    with_ctes(PARSED, body="""SELECT chunk, line_no FROM (SELECT chunk, unnest(range(1, total_lines + 1)) AS line_no FROM q)
WHERE (chunk, line_no) NOT IN (SELECT (chunk, line_no) FROM r)"""),
)
def _(spark, sf):
    q, r = _parsed(spark, sf)
    return S.missing_ids(q, r, "chunk")


@query("union_terms", with_ctes(B.TERMS, body="SELECT term FROM terms UNION SELECT value FROM terms"))
def _(spark, sf):
    t = B.terms(spark, sf)
    return S.union_terms(t, t.select(F.col("value").alias("term")))


NEW = """nw AS (SELECT term, min_by(value, i) AS value, min(i) AS pos FROM (SELECT p_type || ' ' || p_size AS term, p_brand AS value, p_partkey AS i FROM part
  UNION ALL SELECT p_name, p_brand, p_partkey + 1000000 FROM part WHERE p_size > 40) GROUP BY term)"""


@query(
    "glossary_insert",
    with_ctes(B.GLOSSARY, NEW, body="""SELECT * FROM glossary UNION ALL SELECT (SELECT max(id) FROM glossary) + row_number() OVER (ORDER BY pos), term, value, '일반'
FROM nw WHERE term NOT IN (SELECT term FROM glossary)"""),
)
def _(spark, sf):
    p = table(spark, sf, "part")
    a = p.select(
        F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("term"), F.col("p_brand").alias("value"),
        F.lit(" ").alias("category"), F.col("p_partkey").alias("pos"),
    )
    b = p.where("p_size > 40").select(
        F.col("p_name").alias("term"), F.col("p_brand").alias("value"), F.lit("x").alias("category"), (F.col("p_partkey") + 1000000).alias("pos")
    )
    return S.glossary_insert(B.glossary(spark, sf), a.unionByName(b))


@query(
    "glossary_update",
    with_ctes(B.GLOSSARY, """ch AS (SELECT term, min(id) AS id FROM glossary GROUP BY term HAVING length(term) % 2 = 0)""",
              body="""SELECT g.id, coalesce(upper(ch.term), g.term) AS term, coalesce('new', g.value) AS value, g.category, ch.term IS NOT NULL AS updated
FROM glossary g LEFT JOIN ch ON ch.id = g.id WHERE ch.id IS NOT NULL UNION ALL SELECT id, term, value, category, FALSE FROM glossary WHERE id NOT IN (SELECT id FROM ch)"""),
)
def _(spark, sf):
    g = B.glossary(spark, sf)
    ch = g.where(F.length("term") % 2 == 0).select("term").distinct().select(
        "term", F.upper("term").alias("new_term"), F.lit("new").alias("new_value"), F.lit("").alias("new_category")
    )
    return S.glossary_update(g, ch)


DEL = "SELECT DISTINCT p_name FROM part WHERE p_size = 7 AND p_type = 'SMALL'"


@query("glossary_delete", with_ctes(B.GLOSSARY, body=f"SELECT * FROM glossary WHERE term NOT IN ({DEL})"))
def _(spark, sf):
    keys = table(spark, sf, "part").where("p_size = 7 and p_type = 'SMALL'").select(F.col("p_name").alias("term"))
    return S.glossary_delete(B.glossary(spark, sf), keys)


@query("missing_keys", with_ctes(B.GLOSSARY, B.TERMS, body="SELECT term FROM terms WHERE term NOT IN (SELECT string_split(term, ' ')[1] FROM glossary)"))
def _(spark, sf):
    g = B.glossary(spark, sf).select(F.split_part("term", F.lit(" "), F.lit(1)).alias("term"))
    return S.missing_keys(B.terms(spark, sf).select("term"), g)


@query("drop_category", with_ctes(B.GLOSSARY, body="SELECT id, term, value, CASE WHEN category = 'SMALL' THEN '일반' ELSE category END AS category FROM glossary"))
def _(spark, sf):
    return S.drop_category(B.glossary(spark, sf), "SMALL")


@query(
    "rename_items",
    with_ctes(B.LIBRARY, """rn AS (SELECT (event_id * 3) % 15000 AS slide_id, event_id AS pos, CASE WHEN value < 10 THEN ' ' ELSE event_type || ':' || value END AS n FROM events),
ls AS (SELECT slide_id, max_by(trim(replace(n, ':', '')), pos) AS n FROM rn WHERE trim(n) <> '' GROUP BY slide_id)""",
              body="SELECT slide_id, CASE WHEN ls.n IS NOT NULL THEN ls.n || '.pdf' ELSE filename END AS filename FROM library LEFT JOIN ls USING (slide_id)"),
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("event_id") * 3 % 15000).alias("slide_id"), F.col("event_id").alias("pos"),
        F.when(F.col("value") < 10, " ").otherwise(F.concat("event_type", F.lit(":"), F.col("value").cast("string"))).alias("new_name"),
    )
    return S.rename_items(B.library(spark, sf), e).select("slide_id", "filename")


@query(
    "set_last_page",
    with_ctes(B.LIBRARY, B.EV, "vw AS (SELECT (event_id * 3) % 15000 AS slide_id, max_by(k, (ts_ms, event_id)) AS p FROM ev WHERE k >= 1 GROUP BY ALL)",
              body="SELECT slide_id, coalesce(p, 1) AS last_page FROM library LEFT JOIN vw USING (slide_id)"),
)
def _(spark, sf):
    v = B.ev(spark, sf).select((F.col("event_id") * 3 % 15000).alias("slide_id"), F.col("k").alias("page"), "ts_ms", "event_id")
    lib = B.library(spark, sf).withColumn("last_page", F.lit(None).cast("long"))
    return S.set_last_page(lib, v, ORDER).select("slide_id", "last_page")


@query(
    "loadable_items",
    with_ctes(B.LIBRARY, """st AS (SELECT slide_id, page_number, TRUE AS has FROM translated WHERE slide_id % 2 = 0),
dn AS (SELECT * FROM library JOIN pages_of USING (slide_id) WHERE status = 'completed')""",
              body="""SELECT slide_id, page_number, has AS has_translation FROM st WHERE slide_id IN (SELECT slide_id FROM dn)
UNION ALL SELECT p.slide_id, p.page_number, t.slide_id IS NOT NULL FROM (SELECT slide_id, unnest(range(total_pages)) AS page_number FROM dn WHERE slide_id NOT IN (SELECT slide_id FROM st)) p
LEFT JOIN translated t ON t.slide_id = p.slide_id AND t.page_number = p.page_number"""),
)
def _(spark, sf):
    t = B.translated(spark, sf)
    stored = t.where("slide_id % 2 = 0").withColumn("has_translation", F.lit(True))
    lib = B.library(spark, sf).join(B.pages_of(spark, sf), "slide_id")
    out = S.loadable_items(lib, stored, t)
    return out.withColumn("page_number", F.col("page_number").cast("long"))


