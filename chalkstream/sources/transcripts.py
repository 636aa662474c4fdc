"""Session logs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..functions import text as T
from ..functions.strict_json import is_json
from ..operators.windows import cue_times
from ..plans.scans import RowNumber, with_scans

SEGMENT = (
    "seq int, t_offset double, ts_utc timestamp, original string, translated string, slide_id string, page int"
)
META = "session_id string, slide_id string, started_at timestamp, ended_at timestamp, total_segments long"
_CORRUPT = "_corrupt"


def parse_segments(lines: DataFrame, key: str = "session_id", col: str = "value") -> DataFrame:
    """Good lines of a session log; blank and broken lines are skipped."""
    row = F.from_json(col, f"{SEGMENT}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = lines.where((T.strip(F.col(col)) != "") & is_json(F.col(col))).withColumn("_r", row)
    good = rows.where(F.col(f"_r.{_CORRUPT}").isNull() & F.col("_r").isNotNull())
    return good.select(key, "_r.*").drop(_CORRUPT)


def read_segment_logs(spark: SparkSession, path: str) -> DataFrame:
    """All session logs below ``path`` (``session_id=.../*.json``), good lines only."""
    return parse_segments(spark.read.text(path))


def finalize_session(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """Session documents as rows: one of ``position`` 0 with ``meta`` and ``total_segments``, then one with a ``segment``
    for each segment in order. No row holds more than one segment, so a session may have any length. Sessions without
    segments have a total of 0; segments of sessions without meta are left out."""
    totals = segments.groupBy("session_id").agg(F.count(F.lit(1)).alias("_total"))
    about = [c for c in meta.columns if c not in ("session_id", "total_segments")]
    said = [c for c in segments.columns if c != "session_id"]
    heads = meta.join(totals, "session_id", "left").select(
        "session_id", F.lit(0).cast("long").alias("position"), F.coalesce("_total", F.lit(0)).cast("long").alias("total_segments"),
        *([F.struct(*about).alias("meta")] if about else []),
    )
    known = segments.join(meta.select("session_id").distinct(), "session_id", "left_semi")
    rows = with_scans(known, ["session_id"], ["seq"], {"_n": RowNumber()}).select(
        "session_id", F.col("_n").cast("long").alias("position"), F.struct(*said).alias("segment")
    )
    return heads.unionByName(rows, allowMissingColumns=True)


def write_sessions(sessions: DataFrame, path: str) -> None:
    """JSON lines below ``path``, each session in order: meta first, then its segments. Rows are range-partitioned, so files
    follow each other in name order and no session needs one task."""
    ranged = sessions.repartitionByRange("session_id", "position").sortWithinPartitions("session_id", "position")
    ranged.write.mode("overwrite").json(path)


def export_srt(segments: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """Numbered subtitle cues, one row each (``cue_no``, ``cue``); ``write_export`` joins them in files."""
    timed = cue_times(segments, key, seq)
    text = F.concat_ws(
        "\n",
        F.col("cue_no").cast("string"),
        F.concat(clock.srt_time(F.col("t_offset")), F.lit(" --> "), clock.srt_time(F.col("t_end"))),
        F.coalesce("original", F.lit("")),
        F.coalesce("translated", F.lit("")),
        F.lit(""),
    )
    return timed.select(key, "cue_no", text.alias("cue"))


def export_txt(segments: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """Plain transcript, two lines per segment, with the page where one is set."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(
        F.lit("["), clock.minute_time(F.col("t_offset")), F.lit("]"), page, F.lit(" "),
        F.coalesce("original", F.lit("")), F.lit("\n          → "), F.coalesce("translated", F.lit("")),
    )
    return segments.select(key, F.col(seq).cast("long").alias("line_no"), line.alias("line"))


def write_export(cues: DataFrame, path: str, key: str, order: str, col: str) -> None:
    """Text files below ``path/<key>=.../``. Rows are range-partitioned by (key, order), so files of a
    long session follow each other in name order and no session needs one task."""
    ranged = cues.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order)
    ranged.select(key, F.col(col).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Meta files below ``path``, unreadable ones skipped, newest first."""
    raw = spark.read.option("pathGlobFilter", "*.meta.json").text(path, wholetext=True)
    return sessions_from(raw)


def sessions_from(raw: DataFrame, col: str = "value") -> DataFrame:
    row = F.from_json(col, f"{META}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = raw.where(is_json(F.col(col))).withColumn("_r", row).where(F.col(f"_r.{_CORRUPT}").isNull() & F.col("_r.session_id").isNotNull())
    return rows.select("_r.*").drop(_CORRUPT).orderBy(F.desc("started_at"), "session_id")
