"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import layout as L
from ..operators import terms as TM
from ..session import table
from . import base as B
from .base import query, with_ctes

# --- blocks and translations: one block per conversation turn -------------------------------------
BLOCKS = """blocks AS (SELECT 'p' || conv_id || '_b' || turn AS block_id, conv_id AS doc, turn AS pos, text FROM conversations),
answers AS (SELECT block_id, pos, CASE WHEN length(text) % 3 = 0 THEN ' ' ELSE upper(block_id) END AS translated
  FROM blocks WHERE length(text) % 7 <> 1)"""


def _blocks(spark, sf):
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_b"), F.col("turn").cast("string")).alias("block_id"),
        F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "text",
    )


def _answers(spark, sf):
    return _blocks(spark, sf).where(F.length("text") % 7 != 1).select(
        "block_id", "pos", F.when(F.length("text") % 3 == 0, " ").otherwise(F.upper("block_id")).alias("translated")
    )


@query(
    "attach_translations",
    with_ctes(BLOCKS, body="""SELECT b.block_id, b.text, coalesce(nullif(trim(a.translated), ''), b.text) AS translated
FROM blocks b LEFT JOIN answers a USING (block_id)"""),
)
def _(spark, sf):
    return J.attach_translations(_blocks(spark, sf).select("block_id", "text"), _answers(spark, sf))


@query(
    "missing_translations",
    with_ctes(BLOCKS, body="""SELECT block_id, text FROM blocks
WHERE block_id NOT IN (SELECT block_id FROM answers WHERE trim(translated) <> '')"""),
)
def _(spark, sf):
    return J.missing_translations(_blocks(spark, sf).select("block_id", "text"), _answers(spark, sf))


@query(
    "known_responses",
    """WITH r AS (SELECT user_id AS chunk, (event_id * 7) % 40 AS line_no, event_id AS pos, event_type AS answer FROM events),
q AS (SELECT c_custkey AS chunk, unnest(range(20)) AS line_no FROM customer)
SELECT chunk, line_no, max_by(answer, pos) AS answer FROM r JOIN q USING (chunk, line_no) GROUP BY chunk, line_no""",
)
def _(spark, sf):
    r = table(spark, sf, "events").select(
        F.col("user_id").alias("chunk"), (F.col("event_id") * 7 % 40).alias("line_no"), F.col("event_id").alias("pos"),
        F.col("event_type").alias("answer"),
    )
    q = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<long>")).alias("line_no")
    )
    return J.known_responses(r, q, ["chunk", "line_no"])


@query(
    "attach_layout",
    with_ctes(
        BLOCKS,
        """lay AS (SELECT conv_id AS doc, turn * 2 AS idx, length(text) % 2 = 0 AS on_image, length(text) % 3 = 0 AS expand_ok, turn % 2 = 0 AS keep_prefix FROM conversations)""",
        """b AS (SELECT doc, pos, CASE WHEN pos % 3 = 0 THEN 'x' || doc ELSE block_id END AS block_id,
  CASE WHEN pos % 3 = 0 THEN pos ELSE pos END AS i FROM blocks)""",
        body="""SELECT b.doc, b.pos, b.block_id, coalesce(lay.on_image, FALSE) AS on_image, coalesce(lay.expand_ok, TRUE) AS expand_ok,
  coalesce(lay.keep_prefix, FALSE) AS keep_prefix FROM b LEFT JOIN lay ON lay.doc = b.doc AND lay.idx = b.i""",
    ),
)
def _(spark, sf):
    b = _blocks(spark, sf).select(
        "doc", "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("x"), F.col("doc").cast("string"))).otherwise(F.col("block_id")).alias("block_id")
    )
    lay = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc"), (F.col("turn") * 2).alias("idx"), (F.length("text") % 2 == 0).alias("on_image"),
        (F.length("text") % 3 == 0).alias("expand_ok"), (F.col("turn") % 2 == 0).alias("keep_prefix"),
    )
    return J.attach_layout(b, lay, ["doc"])


@query(
    "dedup_against_library",
    """WITH lib AS (SELECT doc_id AS slide_id, sha256(text) AS h FROM documents WHERE lang <> 'de' AND n_chars % 2 = 0),
done AS (SELECT h, max(slide_id) AS existing_id FROM lib GROUP BY h)
SELECT doc_id, sha256(text) AS content_hash, existing_id, existing_id IS NOT NULL AS deduplicated
FROM documents LEFT JOIN done ON sha256(text) = h""",
)
def _(spark, sf):
    d = B.documents(spark, sf)
    lib = d.select(
        F.col("doc_id").alias("slide_id"), F.col("doc_id").alias("uploaded_at"), F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("lang") != "de", "completed").otherwise("failed").alias("status"), (F.col("n_chars") % 2 == 0).alias("file_exists"),
    )
    return J.dedup_against_library(d.select("doc_id", "text"), lib, F.col("text")).select(
        "doc_id", "content_hash", "existing_id", "deduplicated"
    )


@query(
    "pending_pages",
    with_ctes(B.LIBRARY, body="""SELECT DISTINCT l_orderkey AS slide_id, l_linenumber - 1 AS page_number FROM lineitem
WHERE (l_orderkey, l_linenumber - 1) NOT IN (SELECT (slide_id, page_number) FROM translated)"""),
)
def _(spark, sf):
    pages = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("slide_id"), (F.col("l_linenumber") - 1).alias("page_number")
    ).distinct()
    return J.pending_pages(pages, B.translated(spark, sf), ["slide_id", "page_number"])


@query(
    "migrate_orphans",
    with_ctes(B.LIBRARY, body="""SELECT slide_id, uploaded_at, total_pages, slide_id || '.pdf' AS filename, 'completed' AS status
FROM library JOIN pages_of USING (slide_id) WHERE status = 'pending'"""),
)
def _(spark, sf):
    lib = B.library(spark, sf)
    images = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"))
    return J.migrate_orphans(lib.select("slide_id", "uploaded_at"), lib.where("status <> 'pending'"), images)


PAGE_ROWS = """p AS (SELECT slide_id, unnest(range(total_pages)) AS page_number FROM library JOIN pages_of USING (slide_id) WHERE {0}),
m AS (SELECT slide_id, page_number, TRUE AS has FROM translated)"""


@query(
    "repair_page_data",
    with_ctes(B.LIBRARY, PAGE_ROWS.format("status = 'processing'"),
              body="SELECT slide_id, page_number, coalesce(has, FALSE) AS has_translation FROM p LEFT JOIN m USING (slide_id, page_number)"),
)
def _(spark, sf):
    lib = B.library(spark, sf).join(B.pages_of(spark, sf), "slide_id", "left").withColumns(
        {"page_rows": F.when(F.col("status") == "processing", 0).otherwise(F.col("total_pages")),
         "total_pages": F.coalesce("total_pages", F.lit(0))}
    )
    out = J.repair_page_data(lib, B.translated(spark, sf))
    return out.withColumn("page_number", F.col("page_number").cast("long"))


# --- lecture events: view = page change, signup = slide choice -------------------------------------
CHANGES = """ch AS (SELECT session_id, ts_ms, event_id, CASE WHEN event_type = 'view' THEN k END AS page,
    CASE WHEN event_type = 'signup' THEN 's' || (k % 5) END AS slide_id FROM ev WHERE event_type IN ('view', 'signup')),
pg AS (SELECT session_id, ts_ms, coalesce(page, 1) AS page FROM ch),
sl AS (SELECT session_id, ts_ms, slide_id FROM ch WHERE slide_id IS NOT NULL)"""


def _changes(spark, sf):
    e = B.ev(spark, sf).where(F.col("event_type").isin("view", "signup"))
    return e.select(
        "session_id", "ts_ms", "event_id", F.when(F.col("event_type") == "view", F.col("k")).alias("page"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), (F.col("k") % 5).cast("string"))).alias("slide_id"),
    )


@query(
    "asof_page",
    with_ctes(B.EV, CHANGES, body="""SELECT u.event_id, u.session_id, u.ts_ms, coalesce(pg.page, 1) AS page_in_force, sl.slide_id AS slide_in_force
FROM (SELECT * FROM ev WHERE event_type = 'purchase') u ASOF LEFT JOIN pg ON pg.session_id = u.session_id AND pg.ts_ms <= u.ts_ms
ASOF LEFT JOIN sl ON sl.session_id = u.session_id AND sl.ts_ms <= u.ts_ms"""),
)
def _(spark, sf):
    said = B.ev(spark, sf).where("event_type = 'purchase'").select("session_id", "ts_ms", "event_id")
    return J.asof_page(said, _changes(spark, sf))


@query(
    "guard_cursor",
    with_ctes(B.EV, CHANGES, body="""SELECT u.event_id, u.value > 5 AND (u.k % 7 = 0 OR u.k % 9 = coalesce(pg.page, 1) % 9) AS visible
FROM (SELECT * FROM ev WHERE event_type = 'click') u
ASOF LEFT JOIN (SELECT session_id, ts_ms, page FROM pg) pg ON pg.session_id = u.session_id AND pg.ts_ms <= u.ts_ms"""),
)
def _(spark, sf):
    # Pages are taken modulo 9 so that both outcomes occur.
    cursors = B.ev(spark, sf).where("event_type = 'click'").select(
        "session_id", "ts_ms", "event_id", (F.col("value") > 5).alias("visible"),
        F.when(F.col("k") % 7 != 0, F.col("k") % 9).alias("cursor_page"),
    )
    changes = _changes(spark, sf).withColumn("page", F.col("page") % 9)
    return J.guard_cursor(cursors, changes).select("event_id", "visible")


LIFE = "CASE WHEN event_type = 'signup' THEN 'start' WHEN k % 4 = 0 THEN 'end' WHEN k % 4 = 1 THEN 'resume' ELSE 'pause' END"


def _lifecycle(spark, sf):
    k = F.col("k") % 4
    return B.ev(spark, sf).where(F.col("event_type").isin("signup", "error")).select(
        "session_id", "ts_ms", "event_id",
        F.when(F.col("event_type") == "signup", "start").when(k == 0, "end").when(k == 1, "resume").otherwise("pause").alias("type"),
    )


@query(
    "within_active",
    with_ctes(B.EV, f"life AS (SELECT session_id, ts_ms, {LIFE} AS type FROM ev WHERE event_type IN ('signup', 'error'))",
              body="""SELECT u.event_id, u.session_id, u.ts_ms FROM (SELECT * FROM ev WHERE event_type = 'purchase') u
ASOF JOIN (SELECT session_id, ts_ms, type FROM life WHERE type IN ('start', 'end')) r ON r.session_id = u.session_id AND r.ts_ms <= u.ts_ms
ASOF LEFT JOIN life p ON p.session_id = u.session_id AND p.ts_ms <= u.ts_ms
WHERE r.type = 'start' AND p.type <> 'pause'"""),
)
def _(spark, sf):
    rows = B.ev(spark, sf).where("event_type = 'purchase'").select("session_id", "ts_ms", "event_id")
    return J.within_active(rows, _lifecycle(spark, sf)).select("event_id", "session_id", "ts_ms")


# --- words of a turn, half a second each; the turn's text split into sentences ----------------------
WORDS = r"""turns AS (SELECT conv_id * 1000 + turn AS utt_id, regexp_replace(text, '[\s]+', ' ', 'g') AS text FROM conversations),
w AS (SELECT utt_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM
  (SELECT utt_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM turns)),
wc AS (SELECT *, coalesce(sum(length(word)) OVER (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM w)"""


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), F.regexp_replace("text", r"[\s]+", " ").alias("text")
    )


def _words(spark, sf):
    w = _turns(spark, sf).select("utt_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("pos", "word"))
    return w.select(
        "utt_id", F.col("pos").cast("long").alias("pos"), "word", (F.col("pos") * 0.5).alias("start"),
        (F.col("pos") * 0.5 + 0.25).alias("stop"),
    )


@query(
    "trim_words",
    with_ctes(WORDS, body="""SELECT utt_id, pos, word FROM wc JOIN turns USING (utt_id)
WHERE f < length(replace(regexp_replace(text, '\\.[^\\.]*$', ''), ' ', ''))""".replace("\\\\", "\\")),
)
def _(spark, sf):
    trimmed = _turns(spark, sf).select("utt_id", F.regexp_replace("text", r"\.[^\.]*$", "").alias("trimmed"))
    return J.trim_words(_words(spark, sf), trimmed).select("utt_id", "pos", "word")


@query(
    "align_words",
    with_ctes(
        WORDS,
        r"""s AS (SELECT utt_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM (SELECT utt_id,
  list_filter(string_split(regexp_replace(trim(text), '([\.!\?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM turns)),
sc AS (SELECT *, length(replace(sentence, ' ', '')) AS n, coalesce(sum(length(replace(sentence, ' ', ''))) OVER
  (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM s),
hit AS (SELECT sc.utt_id, sc.pos, min(wc.pos) AS a, max(wc.pos) AS z FROM sc JOIN wc ON sc.utt_id = wc.utt_id
  AND wc.f < sc.f + sc.n AND wc.f + length(wc.word) > sc.f GROUP BY ALL)""",
        body="""SELECT sc.utt_id, sc.pos, sc.sentence,
  CASE WHEN a IS NULL THEN sc.utt_id * 10 ELSE sc.utt_id * 10 + a * 500 END AS start_ms,
  CASE WHEN a IS NULL THEN sc.utt_id * 10 + 60000 ELSE sc.utt_id * 10 + z * 500 + 250 END AS stop_ms
FROM sc LEFT JOIN hit USING (utt_id, pos)""",
    ),
)
def _(spark, sf):
    from ..operators.transforms import sentences

    s = _turns(spark, sf).select("utt_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("pos", F.col("pos").cast("long"))
    chunks = _turns(spark, sf).select(
        "utt_id", (F.col("utt_id") * 10).alias("speech_start_ms"), F.lit(60000).cast("long").alias("duration_ms")
    )
    return J.align_words(_words(spark, sf), s, chunks)


NEAR = """SELECT a.page, a.pos FROM regions a WHERE EXISTS (SELECT 1 FROM regions b WHERE b.page = a.page
  AND (a.x0 <> b.x0 OR a.y0 <> b.y0 OR a.x1 <> b.x1 OR a.y1 <> b.y1)
  AND sqrt(pow((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + pow((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2)) < {0})"""


@query(
    "isolated_regions",
    with_ctes(B.REGIONS, f"near AS ({NEAR.format(150)})",
              body=r"""SELECT page, pos, n.pos IS NULL AS isolated,
  CASE WHEN n.pos IS NULL AND (x1 - x0) * (y1 - y0) < 3000 AND length(regexp_replace(text, '\s+', '', 'g')) < 9
    THEN 'STRICT_LITERAL' ELSE 'CONTEXT_AWARE' END AS text_class
FROM regions LEFT JOIN near n USING (page, pos)"""),
)
def _(spark, sf):
    sizes = B.page_sizes(spark, sf)
    out = J.isolated_regions(B.regions(spark, sf, sizes), ["page"], distance=150.0, max_chars=9, most=sizes[0])
    return out.select("page", "pos", "isolated", "text_class")


@query(
    "classify_constraint",
    with_ctes(
        B.REGIONS, f"near AS ({NEAR.format(80)})",
        """aligned AS (SELECT a.page, a.pos FROM regions a WHERE EXISTS (SELECT 1 FROM regions b WHERE b.page = a.page
  AND (a.x0 <> b.x0 OR a.y0 <> b.y0 OR a.x1 <> b.x1 OR a.y1 <> b.y1)
  AND (((abs(a.y0 - b.y0) < 25 OR abs(a.y1 - b.y1) < 25) AND (abs(a.x1 - b.x0) < 50 OR abs(b.x1 - a.x0) < 50))
    OR (abs(a.x0 - b.x0) < 25 AND (abs(a.y1 - b.y0) < 75 OR abs(b.y1 - a.y0) < 75)))))""",
        body=r"""SELECT page, pos, CASE WHEN n.pos IS NULL AND g.pos IS NULL AND (x1 - x0) * (y1 - y0) / (page_width * page_height) < 0.015::DOUBLE
    AND (x1 - x0) / (y1 - y0) < length(text) * 0.5::DOUBLE + 3 AND length(text) < 15
    AND NOT regexp_matches(text, '[\.,;:!\?]') AND NOT regexp_matches(text, '^[\-•·ㆍ●]') THEN 'STRICT_LITERAL' ELSE 'CONTEXT_AWARE' END AS "constraint"
FROM regions LEFT JOIN near n USING (page, pos) LEFT JOIN aligned g USING (page, pos)""",
    ),
)
def _(spark, sf):
    sizes = B.page_sizes(spark, sf)
    out = J.classify_constraint(B.regions(spark, sf, sizes), ["page"], most=sizes[0])
    return out.select("page", "pos", "constraint")


@query(
    "attach_bullets",
    with_ctes(B.REGIONS, body="""SELECT page, pos, EXISTS (SELECT 1 FROM regions b WHERE b.page = a.page AND b.has_bullet AND b.pos < a.pos
  AND b.x0 < a.x0 AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) < (a.y1 - a.y0) * 8) AS has_bullet
FROM regions a WHERE NOT has_bullet"""),
)
def _(spark, sf):
    r = B.regions(spark, sf)
    most = B.page_sizes(spark, sf, "l_returnflag = 'R'")[0]
    out = J.attach_bullets(r.where("not has_bullet"), r.where("has_bullet"), ["page"], reach=8.0, most=most)
    return out.select("page", "pos", "has_bullet")


@query(
    "reconcile_delete",
    with_ctes(B.LIBRARY, """req AS (SELECT event_id AS pos, (event_id * 13) % 9000 AS slide_id FROM events),
first AS (SELECT slide_id, min(pos) AS first FROM req GROUP BY slide_id)""",
              body="""SELECT pos, req.slide_id, CASE WHEN pos = first AND l.slide_id IS NOT NULL THEN 'deleted' ELSE 'failed' END AS outcome,
  CASE WHEN NOT (pos = first AND l.slide_id IS NOT NULL) THEN '강의자료를 찾을 수 없습니다' END AS reason
FROM req JOIN first USING (slide_id) LEFT JOIN (SELECT slide_id FROM library WHERE status <> 'pending') l USING (slide_id)"""),
)
def _(spark, sf):
    req = table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 13 % 9000).alias("slide_id"))
    return J.reconcile_delete(req, B.library(spark, sf).where("status <> 'pending'"))


@query(
    "match_cancel_tokens",
    with_ctes(B.EV, """x AS (SELECT event_id, session_id AS token, ts_ms, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS side
  FROM ev WHERE event_type IN ('error', 'purchase')),
y AS (SELECT *, lag(side) OVER w AS ps, lag(ts_ms) OVER w AS pt FROM x WINDOW w AS (PARTITION BY token ORDER BY ts_ms, side, event_id))""",
              body="SELECT event_id, token, ts_ms, coalesce(ps = 0 AND ts_ms - pt < 21600000, FALSE) AS cancelled FROM y WHERE side = 1"),
)
def _(spark, sf):
    e = B.ev(spark, sf).withColumnRenamed("session_id", "token")
    # Events of one user are hours apart, so the limit is six hours here.
    return J.match_cancel_tokens(
        e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ttl_ms=21_600_000
    )


@query(
    "participants",
    with_ctes(B.EV, """j AS (SELECT session_id % 20 AS session_id, session_id AS user_id, min(ts_ms) AS joined_ms, max(ts_ms) AS left_ms,
  max_by(event_type, ts_ms) AS last FROM ev GROUP BY ALL),
m AS (SELECT session_id, user_id, joined_ms AS ts_ms, 'join' AS type, last FROM j
  UNION ALL SELECT session_id, user_id, left_ms, 'leave', last FROM j WHERE last = 'error'),
a AS (SELECT *, sum(CASE type WHEN 'join' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id ORDER BY ts_ms, type, user_id)::BIGINT AS viewers FROM m)""",
              body="""SELECT session_id, user_id, ts_ms AS joined_ms, coalesce(CASE WHEN c_nationkey % 3 <> 0 THEN c_name END, 'Guest' || viewers) AS name,
  coalesce(CASE WHEN c_nationkey % 2 = 0 THEN 'ko' END, 'en') AS audio_lang FROM a JOIN customer ON c_custkey = user_id WHERE type = 'join' AND last <> 'error'"""),
)
def _(spark, sf):
    e = B.ev(spark, sf).withColumns({"user_id": F.col("session_id"), "session_id": F.col("session_id") % 20})
    seen = e.groupBy("session_id", "user_id").agg(
        F.min("ts_ms").alias("joined_ms"), F.max("ts_ms").alias("left_ms"), F.max_by("event_type", "ts_ms").alias("last")
    )
    joins = seen.select("session_id", "user_id", F.col("joined_ms").alias("ts_ms"), F.lit("join").alias("type"))
    leaves = seen.where("last = 'error'").select("session_id", "user_id", F.col("left_ms").alias("ts_ms"), F.lit("leave").alias("type"))
    registry = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, "ko").alias("audio_lang"),
    )
    return J.participants(joins.unionByName(leaves), registry)


@query(
    "merge_groups",
    "WITH RECURSIVE " + B.REGIONS + """, mb AS (SELECT page, pos, color = 1 AS asks, max(pos) OVER (PARTITION BY page) AS last FROM regions),
f AS (SELECT page, pos, last, asks AND last > pos AS heads, asks AND pos + 1 <= last AS t1, asks AND pos + 2 <= last AS t2, FALSE AS mine FROM mb WHERE pos = 1
  UNION ALL SELECT b.page, b.pos, b.last, b.asks AND NOT f.t1 AND ((b.pos + 1 <= b.last AND NOT f.t2) OR b.pos + 2 <= b.last),
    f.t2 OR (b.asks AND NOT f.t1 AND b.pos + 1 <= b.last), b.asks AND NOT f.t1 AND b.pos + 2 <= b.last, f.t1
  FROM f JOIN mb b ON b.page = f.page AND b.pos = f.pos + 1),
h AS (SELECT *, lag(t2) OVER w AS taken1, row_number() OVER (PARTITION BY page, heads ORDER BY pos) AS g FROM f WINDOW w AS (PARTITION BY page ORDER BY pos)),
m AS (SELECT page, g, unnest(list_concat([pos], list_concat(CASE WHEN pos + 1 <= last AND NOT coalesce(taken1, FALSE) THEN [pos + 1] ELSE [] END, CASE WHEN pos + 2 <= last THEN [pos + 2] ELSE [] END))) AS p FROM h WHERE heads)
SELECT page, g AS group_no, row_number() OVER (PARTITION BY page, g ORDER BY p) AS member_no, 'p' || page || '_b' || p AS block_id FROM m""",
)
def _(spark, sf):
    li = B.regions(spark, sf).select(
        "page", "pos",
        F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("pos").cast("string")).alias("block_id"),
        F.when(F.col("color") == 1, F.array(F.col("pos") + 1, F.col("pos") + 2)).otherwise(F.array().cast("array<bigint>")).alias("merge_with"),
    )
    return L.merge_groups(li, ["page"])


# --- dictionary -------------------------------------------------------------------------------------
@query(
    "match_terms",
    with_ctes(B.TERMS, body="""SELECT doc_id, term, value, (length(text) - length(replace(text, term, ''))) // length(term) AS occurrences
FROM documents, terms WHERE contains(text, term)"""),
)
def _(spark, sf):
    return TM.match_terms(B.documents(spark, sf).select("doc_id", "text"), B.terms(spark, sf)).select(
        "doc_id", "term", "value", "occurrences"
    )


@query(
    "select_terms",
    with_ctes(B.TERMS, """d AS (SELECT doc_id AS page, text FROM documents UNION ALL SELECT 1000000000000 + conv_id, text FROM conversations)""",
              "j AS (SELECT page, string_agg(text, ' ' ORDER BY text) AS whole FROM d GROUP BY page)",
              """r AS (SELECT page, term, value, EXISTS (SELECT 1 FROM d WHERE d.page = j.page AND contains(d.text, term)) AS inside FROM j, terms WHERE contains(whole, term))""",
              body="""SELECT page, rank, term, value FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY inside DESC, length(term) DESC, term) AS rank FROM r) WHERE rank <= 25"""),
)
def _(spark, sf):
    d = B.documents(spark, sf).select(F.col("doc_id").alias("page"), "text")
    c = table(spark, sf, "conversations").select((F.col("conv_id") + 1000000000000).alias("page"), "text")
    pages = d.unionByName(c).withColumn("pos", F.col("text"))
    return TM.select_terms(pages, B.terms(spark, sf), ["page"])
