"""Structured Streaming forms of the live operators. Each names its batch twin."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..operators import gates as G
from ..operators import inference as I
from ..operators import transforms as X
from ..operators import windows as Wn
from ..plans.folds import Affine, Sequential, ordered_fold
from ..plans.scans import Lag, Lead, RunSum, with_scans
from ..plans.sizes import group_sizes
from ..session import checkpoint_dir
from .held import Ending, held_fold, late_rows
from .stateful import stateful_fold


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


# ------------------------------------------------------------------------------ running a stream
def read_table_stream(spark: SparkSession, sf_dir: str, name: str, batch: int = 64 << 20) -> DataFrame:
    """A parquet table, a folder of files or a single one, as a file stream. A micro-batch takes files of ``batch`` bytes
    together, so many small files do not each cost a commit of all state."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(stream: DataFrame, path: str | None = None, ending: Ending | None = None) -> DataFrame:
    """Run an append stream over what its source holds now into a parquet table; exactly once, since
    the file sink and the checkpoint share the folder. With ``ending`` the stream is then told that nothing more
    comes, and goes on from its checkpoint until all held rows are out. Rows later than the watermark fail the run:
    the lateness the stream was given is too short for its files."""
    spark = stream.sparkSession
    path = path or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for last in (False, True) if ending else (True,):
        q = (
            stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log")
            .outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination()
        if ending and late_rows(q):
            raise ValueError(f"{late_rows(q)} rows came later than the watermark allows")
        if not last:
            ending.announce()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_updates_to_table(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Run an update stream; every batch writes its changed keys below its own number, so a repeated
    batch overwrites itself. Reading takes the newest row of each key."""
    spark = stream.sparkSession
    path = path or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    q = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/log")
        .outputMode("update").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    cols = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_v")).select(*keys, "_v.*")


# ------------------------------------------------------------------------------ stateless
def captions(
    utterances: DataFrame, load: I.Model, script: str = P.HANGUL, batch: int = 32, terms: list[str] | None = None,
    gate: dict | None = None, output: dict | None = None,
) -> DataFrame:
    """Utterance to captions: gate, sentences, model, output gate; empty results skipped. The same
    function serves batch and stream."""
    good = G.kept_rows(G.gate_utterances(utterances, **(gate or {})))
    parts = X.split_sentences(good).drop("text").withColumnRenamed("sentence", "text")
    done = I.infer(parts, load, batch, "translated").where("status = 'ok'").drop("status")
    checked = G.gate_mt_output(
        done.withColumnsRenamed({"text": "original", "translated": "text"}), terms, script, **(output or {})
    )
    return G.kept_rows(checked).where("trim(text) <> ''").withColumnRenamed("text", "translated")


caption_stream = captions


def late_events(df: DataFrame, extra: float = 10_000.0) -> DataFrame:
    """Lateness of an event on arrival. Past targets run at once; only rows later than delay + 10 s
    are marked dropped. Batch and stream alike; put a watermark before for state further down."""
    late = F.col("now_ms") - (F.col("start_ms") + F.col("offset_ms") + F.col("delay_ms"))
    return df.withColumns(
        {
            "late_ms": late, "runs_at_once": late >= 0,
            "dropped": late > F.col("delay_ms") + extra,
        }
    )


# ------------------------------------------------------------------------------ steps
def _folded(stream: DataFrame, keys: list[str], order: list[str], fold, held_by: str | None, held: dict | None) -> DataFrame:
    """In event-time order where ``held_by`` names a watermarked column, else in order of arrival."""
    return held_fold(stream, keys, order, fold, held_by, **(held or {})) if held_by else stateful_fold(stream, keys, order, fold)


def delay_step(
    window: int = 20, initial: float = 2000.0, tts_start: float = 600.0, alpha: float = 0.2, fall: float = 0.25,
    lo: float = 1000.0, hi: float = 20000.0, min_margin: float = 300.0, stddev_share: float = 1.5,
) -> Sequential:
    """Needed delays of a listener, their target and the delay; speech synthesis time is a moving
    average that starts at 600 ms."""

    def first():
        return ([], initial, tts_start)

    def move(state, row):
        recent, delay, tts = state
        lag, tts_ms = row
        recent = [*recent, max(0.0, lag + tts)][-window:]
        n = len(recent)
        if n >= 3:
            mean = sum(recent) / n
            dev = (sum((x - mean) ** 2 for x in recent) / n) ** 0.5
            target = sorted(recent)[int((n - 1) * 0.9)] + max(min_margin, dev * stddev_share)
            target = max(lo, min(hi, target))
            delay = target if target >= delay else delay + (target - delay) * fall
            delay = max(lo, min(hi, delay))
        if tts_ms is not None and tts_ms == tts_ms and tts_ms >= 0:
            tts = tts * (1 - alpha) + tts_ms * alpha
        return (recent, delay, tts), (recent[-1], delay)

    return Sequential(
        ("lag_ms", "tts_ms"), [field("needed_ms", T.DoubleType()), field("delay_ms", T.DoubleType())], first, move
    )


def adaptive_delay_stream(
    stream: DataFrame, keys: list[str], order: list[str], held_by: str | None = None, held: dict | None = None, **how
) -> DataFrame:
    """Keyed by listener and lecture, so a lecture start begins anew. Twin: ``listener_delay``."""
    return _folded(stream, keys, order, delay_step(**how), held_by, held)


def listener_delay(df: DataFrame, key: str, order: list[str], tts_start: float = 600.0, alpha: float = 0.2) -> DataFrame:
    """Batch twin of the delay stream, from scans and affine folds."""
    heard = F.coalesce(F.col("tts_ms") >= 0, F.lit(False))
    coef = df.withColumns(
        {
            "_a": F.when(heard, 1 - alpha).otherwise(1.0), "_b": F.when(heard, F.col("tts_ms") * alpha).otherwise(0.0),
            "_lo": F.lit(-Wn.INF), "_hi": F.lit(Wn.INF),
        }
    )
    sizes = group_sizes(df, [key])
    ewma = ordered_fold(coef, [key], order, Affine(("_a", "_b", "_lo", "_hi"), "_tts", tts_start), sizes=sizes)
    before = with_scans(ewma, [key], order, {"_was": Lag(F.col("_tts"))}, sizes=sizes)
    needed = F.greatest(F.col("lag_ms") + F.coalesce("_was", F.lit(tts_start)), F.lit(0.0))
    rows = before.withColumn("needed_ms", needed).drop("_a", "_b", "_lo", "_hi", "_tts", "_was")
    targets = Wn.delay_target(rows, key, order, sizes=sizes)
    return Wn.adaptive_delay(targets, key, order, sizes=sizes).drop("target_ms")


def repeat_step(window_ms: int = 30_000, max_chars: int = 15) -> Sequential:
    """Anchored on the last accepted courtesy; other texts (``short`` false) leave it alone."""

    def first():
        return (None, 0)

    def move(state, row):
        text, at, short = row
        if not short:
            return state, (False,)
        if state[0] == text and at - state[1] < window_ms:
            return state, (True,)
        return (text, at), (False,)

    return Sequential(("text", "ts_ms", "short"), [field("suppressed", T.BooleanType())], first, move)


def suppress_repeats_stream(
    stream: DataFrame, keys: list[str], order: list[str], courtesy: str = P.COURTESY, window_ms: int = 30_000,
    max_chars: int = 15, event_time: str | None = None, held_by: str | None = None, held: dict | None = None,
) -> DataFrame:
    """Twin: ``windows.suppress_repeats``. Silent keys are forgotten after the window."""
    short = (F.length("text") < max_chars) & F.col("text").rlike(courtesy)
    marked = stream.withColumn("short", short)
    if held_by:
        return held_fold(marked, keys, order, repeat_step(window_ms, max_chars), held_by, **(held or {})).drop("short")
    return stateful_fold(marked, keys, order, repeat_step(window_ms, max_chars), event_time, window_ms).drop("short")


def session_timeouts_stream(df: DataFrame, key: str, ts: str = "ts", grace: str = "30 seconds", late: str | None = "1 minute") -> DataFrame:
    """Stretches of life signs with no silence of the grace period; each ends one grace period after
    its last sign and is emitted once the watermark has passed that; signs come ``late`` at most (None: the stream has its
    watermark). Twin: ``session_timeouts``."""
    marked = df if late is None else df.withWatermark(ts, late)
    return (
        marked.groupBy(key, F.session_window(ts, grace).alias("_w"))
        .agg(F.count(F.lit(1)).alias("signs"))
        .select(key, F.unix_millis("_w.start").alias("start_ms"), F.unix_millis("_w.end").alias("end_ms"), "signs")
    )


def session_timeouts(df: DataFrame, key: str, order: list[str], ts: str = "ts", grace_ms: int = 30_000) -> DataFrame:
    """The batch form, from scans, so that a session of any length is cut over tasks."""
    sizes = group_sizes(df, [key])
    micros = df.withColumn("_us", F.unix_micros(F.col(ts)))
    a = with_scans(micros, [key], order, {"_was": Lag(F.col("_us"))}, sizes=sizes)
    new = F.coalesce(F.col("_us") - F.col("_was") >= grace_ms * 1000, F.lit(True)).cast("long")
    b = with_scans(a.withColumn("_new", new), [key], order, {"_n": RunSum(F.col("_new"))}, sizes=sizes)
    return b.groupBy(key, "_n").agg(
        F.floor(F.min("_us") / 1000).alias("start_ms"), F.floor((F.max("_us") + grace_ms * 1000) / 1000).alias("end_ms"),
        F.count(F.lit(1)).alias("signs"),
    ).drop("_n")


def missed_pongs(df: DataFrame, key: str, order: list[str], ts: str = "ts_ms", wait_ms: int = 10_000) -> DataFrame:
    """Pings with no pong within the wait: the connection is dead."""
    out = with_scans(df, [key], order, {"_t": Lead(F.col("type")), "_at": Lead(F.col(ts))})
    answered = (F.col("_t") == "pong") & (F.col("_at") - F.col(ts) <= wait_ms)
    return out.where(F.col("type") == "ping").withColumn("missed", ~F.coalesce(answered, F.lit(False))).drop("_t", "_at")


def commit_step() -> Sequential:
    """Hypothesis against the one before; the final pass commits the rest and ends the utterance."""

    def first():
        return ([], 0)

    def move(state, row):
        previous, done = state
        joined, final = row
        sentences = joined.split("\u0001") if joined else []
        reach = len(sentences)
        if not final:
            reach = next((i for i, (a, b) in enumerate(zip(previous, sentences)) if a != b), min(len(previous), len(sentences)))
        new = sentences[done:reach]
        total = max(done, reach)
        return (None if final else (sentences, total)), ("|".join(new), total)

    return Sequential(("joined_sentences", "is_final"), [field("committed", T.StringType()), field("committed_total", T.LongType())], first, move)


def stable_commits_stream(
    stream: DataFrame, key: str = "utt_id", order: str = "pass_no", held_by: str | None = None, held: dict | None = None
) -> DataFrame:
    """Twin: ``windows.stable_commits``."""
    joined = stream.withColumn("joined_sentences", F.array_join("sentences", "\u0001")).drop("sentences")
    return _folded(joined, [key], [order], commit_step(), held_by, held).drop("joined_sentences")


def board_step() -> Sequential:
    """Number of the last reset each draw event lives under; state is one number per page."""

    def first():
        return {"start": -1, "pages": {}}

    def move(state, row):
        kind, page, seq = row
        p = str(page)
        if kind == "lecture_start":
            state = {"start": seq, "pages": {}}
        elif kind == "draw_clear":
            state = {"start": state["start"], "pages": {**state["pages"], p: seq}}
        return state, (max(state["start"], state["pages"].get(p, -1)),)

    return Sequential(("type", "page", "seq"), [field("epoch", T.LongType())], first, move)


def board_state_stream(stream: DataFrame, slide: str = "slide", held_by: str | None = None, held: dict | None = None) -> DataFrame:
    """Each event of a slide's boards with the reset it lives under."""
    return _folded(stream, [slide], ["seq"], board_step(), held_by, held)


def board_snapshot(log: DataFrame, slide: str = "slide") -> DataFrame:
    """What a late joiner draws: events of the logged stream that live under the newest reset of their
    board. Twin: ``windows.after_last_clear``."""
    pages = log.where("type <> 'lecture_start'").groupBy(slide, "page").agg(F.max("epoch").alias("_e"))
    starts = log.where("type = 'lecture_start'").groupBy(slide).agg(F.max("seq").alias("_s"))
    draws = log.where(~F.col("type").isin("draw_clear", "lecture_start"))
    joined = draws.join(pages, [slide, "page"]).join(starts, slide, "left")
    return joined.where(
        (F.col("epoch") == F.col("_e")) & (F.col("epoch") >= F.coalesce("_s", F.lit(-1)))
    ).drop("_e", "_s")


def presence_stream(stream: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Latest values per key as an updating aggregate. Twin: ``windows.latest_per_key``."""
    return Wn.latest_per_key(stream, keys, values, order)


def progress_step(baselines: dict[str, float] = P.STAGE_BASELINES) -> Sequential:
    def first():
        return (0, 0.0)

    def move(state, row):
        n, avg = state
        seconds, stage = row
        d = max(0.0, seconds)
        avg = 0.5 * baselines.get(stage, d) + 0.5 * d if n == 0 else 0.75 * avg + 0.25 * d
        return (n + 1, avg), (avg, n + 1)

    return Sequential(
        ("seconds", "stage"), [field("avg_seconds", T.DoubleType()), field("stage_current", T.LongType())], first, move
    )


def job_progress_stream(
    stream: DataFrame, keys: list[str], order: list[str], held_by: str | None = None, held: dict | None = None
) -> DataFrame:
    """Average page time and remaining seconds after each page. Twins: ``page_ema``, ``stage_eta``."""
    out = _folded(stream, keys, order, progress_step(), held_by, held)
    return Wn.stage_eta(out) if {"stage_total", "elapsed"} <= set(out.columns) else out


def token_step(ttl_ms: int = 300_000) -> Sequential:
    """Side 0 parks the token, side 1 is an upload that consumes it."""

    def first():
        return (-1,)

    def move(state, row):
        side, at = row
        if side == 0:
            return (at,), (False,)
        return (-1,), (state[0] >= 0 and at - state[0] < ttl_ms,)

    return Sequential(("side", "ts_ms"), [field("cancelled", T.BooleanType())], first, move)


def cancel_match_stream(
    stream: DataFrame, ttl_ms: int = 300_000, event_time: str | None = None, held_by: str | None = None, held: dict | None = None
) -> DataFrame:
    """Parked tokens (side 0) and uploads (side 1) on one stream. Twin: ``joins.match_cancel_tokens``."""
    if held_by:
        out = held_fold(stream, ["token"], ["ts_ms", "side", "event_id"], token_step(ttl_ms), held_by, **(held or {}))
        return out.where("side = 1")
    out = stateful_fold(stream, ["token"], ["ts_ms", "side", "event_id"], token_step(ttl_ms), event_time, ttl_ms)
    return out.where("side = 1")


def cancel_match_join(tokens: DataFrame, uploads: DataFrame, ttl: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """The same as a stream-stream join with watermarks, for tokens that are parked and used once."""
    t = tokens.select(F.col("token").alias("_token"), F.col("ts").alias("parked_at")).withWatermark("parked_at", late)
    u = uploads.withWatermark("ts", late)
    near = (F.col("ts") >= F.col("parked_at")) & (F.col("ts") < F.col("parked_at") + F.expr(f"INTERVAL {ttl}"))
    return u.join(t, (F.col("token") == F.col("_token")) & near).drop("_token")


def activity_step(threshold: float = 0.01, frame_ms: int = 200, split_ms: int = 1500) -> Sequential:
    """Segment and part of each frame (null outside), and whether the frame starts a segment, which
    also takes the frame before it along."""

    def first():
        return (False, 0, 0)

    def move(state, row):
        speaking, segment, run = state
        loud = row[0] > threshold
        if loud and not speaking:
            return (True, segment + 1, 0), (segment + 1, 0, True)
        if speaking:
            run += 1
            return (loud, segment, run), (segment, run * frame_ms // split_ms, False)
        return (False, segment, run), (None, None, False)

    return Sequential(
        ("rms",),
        [field("segment", T.LongType()), field("part", T.LongType()), field("takes_previous", T.BooleanType())],
        first, move,
    )


def activity_stream(
    stream: DataFrame, keys: list[str], order: list[str], held_by: str | None = None, held: dict | None = None, **how
) -> DataFrame:
    """Twin: ``windows.activity_segments``."""
    return _folded(stream, keys, order, activity_step(**how), held_by, held)


# ------------------------------------------------------------------------------ session log sink
def sequence_step() -> Sequential:
    def first():
        return (0,)

    def move(state, row):
        return (state[0] + 1,), (state[0],)

    return Sequential(("ts_ms",), [field("seq", T.LongType())], first, move)


def append_segments(
    stream: DataFrame, active: DataFrame, path: str, ts: str = "ts_ms", order: tuple[str, ...] = ("ts_ms",),
    held_by: str | None = None, held: dict | None = None, ending: Ending | None = None, late: str = "1 minute",
):
    """Start a stream that appends one JSON line per translated sentence below ``session_id=...``, with
    its number in the session and the offset from the session's start. Sentences of sessions not in
    ``active`` (session_id, started_ms) are ignored. Returns the started query. Where files may come out of order, name
    the event time in ``held_by`` and how ``late`` it may be; start the stream once more after ``ending`` was announced."""
    known = stream.join(active.select("session_id", "started_ms"), "session_id")
    offset = F.bround((F.col(ts) - F.col("started_ms")) / 1000.0, 3)
    rows = known.withColumns({"t_offset": offset, "ts_utc": F.timestamp_millis(F.col(ts))}).drop("started_ms")
    if held_by:
        rows = ending.joined(rows, late) if ending else rows.withWatermark(held_by, late)
    numbered = _folded(rows, ["session_id"], list(order), sequence_step(), held_by, held).drop(ts, held_by or ts)
    return (
        numbered.writeStream.format("json").partitionBy("session_id").option("path", f"{path}/segments")
        .option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    )
