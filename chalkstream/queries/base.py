"""Registry of queries and the bindings of the given tables to the domain's inputs.

Each binding exists twice, as DataFrame code and as the SQL common table expression of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.generate import rows_of
from ..plans.scans import RowNumber, RunSum, with_scans
from ..plans.sizes import group_sizes, spread
from ..session import BATCH_BYTES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for setting, value in {"spark.sql.session.timeZone": "UTC", **BATCH_BYTES}.items():
                spark.conf.set(setting, value)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def pages(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "pages"), "page_id")


# --- segments: one per conversation turn ---------------------------------------------------------
SEGMENTS = """segments AS (
  SELECT conv_id AS session_id, turn AS seq, role, text AS original, 'EN: ' || text AS translated,
         CASE WHEN role = 'user' THEN turn + 1 END AS page,
         coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15.0::DOUBLE AS t_offset
  FROM conversations)"""


def segments(spark, sf) -> DataFrame:
    base = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("original"),
        F.concat(F.lit("EN: "), "text").alias("translated"),
        F.when(F.col("role") == "user", F.col("turn") + 1).alias("page"),
    )
    run = with_scans(base, ["session_id"], ["seq"], {"_chars": RunSum(F.length("original"), inclusive=False)})
    return run.withColumn("t_offset", F.col("_chars") / F.lit(15.0)).drop("_chars")


# --- lines: every line of every document ---------------------------------------------------------
LINES = """lines AS (
  SELECT doc_id, lang, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS text
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"""


def lines(spark, sf) -> DataFrame:
    docs = documents(spark, sf)
    out = rows_of(docs, F.split("text", "\n"), "line_no", "line", ["doc_id", "lang"]).withColumnRenamed("line", "text")
    return out.withColumn("line_no", F.col("line_no").cast("long"))


# --- terms: words of six letters and more, value in upper case ------------------------------------
TERMS = """terms AS (
  SELECT DISTINCT w AS term, upper(w) AS value
  FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS w FROM benchmark))"""


def terms(spark, sf) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("([a-z]{6,})"), F.lit(1))
    words = rows_of(table(spark, sf, "benchmark"), found, "_no", "term", [])
    return words.select("term").distinct().withColumn("value", F.upper("term"))


# --- events: session per user, milliseconds, number from props ------------------------------------
EV = """ev AS (
  SELECT event_id, user_id AS session_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def ev(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("session_id"), clock.epoch_ms(F.col("ts")).alias("ts_ms"), "event_type",
        "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


# --- regions: positioned texts, one page per order ------------------------------------------------
_ROW = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate"
REGIONS = f"""regions AS (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ROW}) AS pos,
         l_quantity * 10 AS x0, l_extendedprice % 1000 AS y0,
         l_quantity * 10 + (20 + l_discount * 1000) AS x1, l_extendedprice % 1000 + (8 + l_tax * 500) AS y1,
         8 + l_tax * 200 AS size, l_linenumber % 3 AS color, l_linenumber // 3 AS block_idx,
         l_discount * 10 AS confidence, l_returnflag = 'R' AS has_bullet,
         CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END
           || CASE l_returnflag WHEN 'R' THEN '.' WHEN 'A' THEN '' ELSE ' x' END AS text,
         600.0::DOUBLE AS page_width, 1000.0::DOUBLE AS page_height
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def page_sizes(spark, sf, kept: str = "true") -> tuple[int, int]:
    """(rows on the largest page, rows in all), counted before parts are looked up."""
    return group_sizes(table(spark, sf, "lineitem").where(kept), ["l_orderkey"])


def regions(spark, sf, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rows leave partitioned and sorted by page: parts are looked up first, so steps along a page move nothing again."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    li = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("page", F.col("l_orderkey"))
    order = [c.strip() for c in _ROW.split(",")]
    li = with_scans(li, ["page"], order, {"pos": RowNumber()}, sizes=sizes or page_sizes(spark, sf))
    rf = F.col("l_returnflag")
    return li.select(
        "page", "pos",
        (F.col("l_quantity") * 10).alias("x0"), (F.col("l_extendedprice") % 1000).alias("y0"),
        (F.col("l_quantity") * 10 + (F.col("l_discount") * 1000 + 20)).alias("x1"),
        (F.col("l_extendedprice") % 1000 + (F.col("l_tax") * 500 + 8)).alias("y1"),
        (F.col("l_tax") * 200 + 8).alias("size"), (F.col("l_linenumber") % 3).cast("int").alias("color"),
        F.floor(F.col("l_linenumber") / 3).alias("block_idx"), (F.col("l_discount") * 10).alias("confidence"),
        (rf == "R").alias("has_bullet"),
        F.concat(
            F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")))
            .otherwise(F.col("p_name")),
            F.when(rf == "R", ".").when(rf == "A", "").otherwise(" x"),
        ).alias("text"),
        F.lit(600.0).alias("page_width"), F.lit(1000.0).alias("page_height"),
    )


# --- library: one item per order, one page per line item ------------------------------------------
LIBRARY = """library AS (
  SELECT o_orderkey AS slide_id, o_orderpriority || ' ' || o_orderkey || '.pdf' AS filename,
         strftime(o_orderdate, '%Y-%m-%d') AS uploaded_at, o_totalprice AS file_size, o_custkey AS owner,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status
  FROM orders),
pages_of AS (
  SELECT l_orderkey AS slide_id, count(*) AS total_pages FROM lineitem GROUP BY l_orderkey),
translated AS (
  SELECT DISTINCT l_orderkey AS slide_id, l_linenumber - 1 AS page_number FROM lineitem WHERE l_returnflag = 'R')"""


def library(spark, sf) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("slide_id"),
        F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("uploaded_at"), F.col("o_totalprice").alias("file_size"),
        F.col("o_custkey").alias("owner"),
        F.when(s == "F", "completed").when(s == "O", "processing").otherwise("pending").alias("status"),
    )


def pages_of(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("slide_id")).agg(
        F.count(F.lit(1)).alias("total_pages")
    )


def translated(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "lineitem").where("l_returnflag = 'R'")
        .select(F.col("l_orderkey").alias("slide_id"), (F.col("l_linenumber") - 1).alias("page_number")).distinct()
    )


# --- glossary: names of parts with brand and type --------------------------------------------------
GLOSSARY = """glossary AS (
  SELECT p_partkey AS id, p_name AS term, p_brand AS value, p_type AS category FROM part)"""


def glossary(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.col("p_brand").alias("value"),
        F.col("p_type").alias("category"),
    )


# --- frames: each vector cut into four frames of 16 samples ---------------------------------------
FRAMES = """frames AS (
  SELECT vec_id, label, f AS frame_no, list_transform(embedding[f * 16 + 1 : f * 16 + 16], lambda x: x::DOUBLE) AS samples,
         16 * (label % 3 + 2) AS rate
  FROM embeddings, (SELECT unnest(range(4)) AS f))"""


def frames(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("frame_no"), "embedding"
    ).select(
        "vec_id", "label", "frame_no",
        F.slice("embedding", (F.col("frame_no") * 16 + 1).cast("int"), 16).alias("samples"),
        ((F.col("label") % 3 + 2) * 16).alias("rate"),
    )


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
