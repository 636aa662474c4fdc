"""Window and fold operators over session, listener and page events.

Everything along an order goes through ``plans.scans`` or ``plans.folds``, so a session that holds
a large share of all rows is cut into ordered blocks instead of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..plans.folds import Affine, Automaton, Sequential, ordered_fold
from ..plans.scans import (
    Lag, LastSeen, Lead, RowNumber, RunMax, RunSum, Tail, with_scans,
)
from ..plans.sizes import group_sizes

INF = float("inf")


def cue_times(
    df: DataFrame, key: str = "session_id", seq: str = "seq", start: str = "t_offset",
    default: float = 4.0, max_gap: float = 10.0,
) -> DataFrame:
    """End of a cue: the next start; start + default for the last cue and for gaps above the cap."""
    out = with_scans(df, [key], [seq], {"_next": Lead(F.col(start)), "cue_no": RowNumber()})
    own = F.col(start) + default
    end = F.when(F.col("_next").isNull() | (F.col("_next") - F.col(start) > max_gap), own).otherwise(F.col("_next"))
    return out.withColumn("t_end", end).drop("_next")


def delay_target(
    df: DataFrame, key: str, order: list[str], needed: str = "needed_ms", window: int = 20,
    min_margin: float = 300.0, stddev_share: float = 1.5, lo: float = 1000.0, hi: float = 20000.0,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Target delay over the last ``window`` needed delays: the value at index floor((n-1)*0.9) plus
    the larger of the margin and 1.5 population deviations; null before three values."""
    out = with_scans(df, [key], order, {"_w": Tail(F.col(needed).cast("double"), window)}, sizes=sizes)
    n = F.size("_w")
    p90 = F.element_at(F.sort_array("_w"), (F.floor((n - 1) * 0.9) + 1).cast("int"))
    out = out.withColumn("_mean", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / n)
    mean = F.col("_mean")
    var = F.aggregate(F.transform("_w", lambda x: F.pow(x - mean, 2)), F.lit(0.0), lambda a, x: a + x) / n
    target = p90 + F.greatest(F.lit(min_margin), F.sqrt(var) * stddev_share)
    clamped = F.greatest(F.lit(lo), F.least(F.lit(hi), target))
    return out.withColumn("target_ms", F.when(n >= 3, clamped)).drop("_w", "_mean")


def adaptive_delay(
    df: DataFrame, key: str, order: list[str], target: str = "target_ms", initial: float = 2000.0,
    fall: float = 0.25, lo: float = 1000.0, hi: float = 20000.0, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Delay that rises to the target at once and falls by a share of the difference.

    One step is ``max(target, (1 - fall) * delay + fall * target)``, clamped: an affine fold.
    """
    t = F.col(target)
    none = t.isNull()
    coef = df.withColumns(
        {
            "_a": F.when(none, 1.0).otherwise(1.0 - fall),
            "_b": F.when(none, 0.0).otherwise(t * fall),
            "_lo": F.when(none, -INF).otherwise(F.greatest(t, F.lit(lo))),
            "_hi": F.when(none, INF).otherwise(hi),
        }
    )
    return ordered_fold(coef, [key], order, Affine(("_a", "_b", "_lo", "_hi"), "delay_ms", initial), sizes=sizes).drop(
        "_a", "_b", "_lo", "_hi"
    )


def clock_offset(
    df: DataFrame, key: str, order: list[str], observed: str = "observed_ms", outlier: float = 5000.0,
    early: float = 0.4, late: float = 0.1, early_samples: int = 5,
) -> DataFrame:
    """Moving average of receive minus send. The first sample sets it, samples 2 to 5 weigh 0.4,
    later ones 0.1; outliers do not count."""
    good = df.where(F.abs(F.col(observed)) <= outlier)
    sizes = group_sizes(good, [key])
    n = with_scans(good, [key], order, {"_n": RowNumber()}, sizes=sizes)
    w = F.when(F.col("_n") == 1, 1.0).when(F.col("_n") <= early_samples, early).otherwise(late)
    coef = n.withColumns({"_a": 1.0 - w, "_b": F.col(observed) * w, "_lo": F.lit(-INF), "_hi": F.lit(INF)})
    return ordered_fold(coef, [key], order, Affine(("_a", "_b", "_lo", "_hi"), "offset_ms"), sizes=sizes).drop(
        "_a", "_b", "_lo", "_hi", "_n"
    )


def schedule_visual(
    df: DataFrame, key: str, order: list[str], ts: str = "ts_ms", offset: str = "offset_ms",
    delay: str = "delay_ms", catch_up: int = 1000,
) -> DataFrame:
    """Show time of a stroke event: the sender's gap after the previous show time when the gap is in
    (0, 1000) ms, else the later of its own due time and the previous show time.

    With G the running sum of kept gaps, show - G is a running maximum of due - G: two scans.
    """
    sizes = group_sizes(df, [key])
    lagged = with_scans(df, [key], order, {"_before": Lag(F.col(ts))}, sizes=sizes)
    gap = F.when(F.col("_before") > 0, F.greatest(F.col(ts) - F.col("_before"), F.lit(0))).otherwise(F.lit(0))
    keep = (gap > 0) & (gap < catch_up)
    gaps = lagged.withColumns({"_keep": keep, "_gap": F.when(keep, gap).otherwise(F.lit(0)).cast("long")})
    summed = with_scans(gaps, [key], order, {"_sum": RunSum(F.col("_gap"))}, sizes=sizes)
    due = F.greatest(F.col(ts) + F.col(offset) + F.col(delay), F.lit(0.0))
    base = summed.withColumn("_due", F.when(~F.col("_keep"), due - F.col("_sum")))
    out = with_scans(base, [key], order, {"_top": RunMax(F.col("_due"))}, sizes=sizes)
    shown = F.coalesce(F.col("_top"), F.lit(0.0)) + F.col("_sum")
    return out.withColumn("show_ms", shown).drop("_before", "_keep", "_gap", "_sum", "_due", "_top")


def schedule_sentences(
    df: DataFrame, key: str, order: list[str], start: str = "start_ms", now: str = "now_ms",
    offset: str = "offset_ms", delay: str = "delay_ms", extra: float = 10_000.0,
) -> DataFrame:
    """Show time of a sentence: the later of its due time and the previous show time. Sentences later
    than delay + 10 s are dropped and do not advance the clock.

    A due time at or after the stale limit is always kept, and one before it never moves the clock,
    so the clock is a running maximum over the former.
    """
    due = F.col(start) + F.col(offset) + F.col(delay)
    limit = F.col(now) - F.col(delay) - extra
    rows = df.withColumns({"_due": due, "_limit": limit})
    kept = F.when(F.col("_due") >= F.col("_limit"), F.col("_due"))
    out = with_scans(rows, [key], order, {"_clock": RunMax(kept, inclusive=False)})
    shown = F.greatest(F.col("_due"), F.col("_clock"), F.lit(0.0))
    return out.withColumns({"show_ms": shown, "dropped": shown < F.col("_limit")}).drop("_due", "_limit", "_clock")


def activity_segments(
    frames: DataFrame, key: str, order: list[str], threshold: float = 0.01, frame_ms: int = 200,
    split_ms: int = 1500, preroll: int = 2, level: str = "rms",
) -> DataFrame:
    """Speech segments of a frame stream, one row per frame that belongs to one.

    A segment starts with the first loud frame and takes the frame before it along; the first quiet
    frame ends it and is kept. A segment is cut every ``split_ms`` of its own duration, counted from
    the first loud frame.
    """
    loud = F.col(level) > threshold
    sizes = group_sizes(frames, [key])
    a = with_scans(
        frames.withColumn("_loud", loud), [key], order,
        {"_was": Lag(F.col("_loud")), "_next": Lead(F.col("_loud")), "_no": RowNumber()}, sizes=sizes,
    )
    was = F.coalesce("_was", F.lit(False))
    starts = F.col("_loud") & ~was
    tail = ~F.col("_loud") & was
    lead_in = ~F.col("_loud") & F.coalesce("_next", F.lit(False))
    # A quiet frame between two segments ends the first and is pre-rolled into the second.
    b = a.withColumns({"_start": starts.cast("int"), "_first_no": F.when(starts, F.col("_no"))})
    b = with_scans(b, [key], order, {"_seg": RunSum(F.col("_start")), "_from": LastSeen(F.col("_first_no"))}, sizes=sizes)
    elapsed = (F.col("_no") - F.col("_from")) * frame_ms
    own = F.struct(F.col("_seg").alias("segment"), F.floor(elapsed / split_ms).alias("part"))
    ahead = F.struct((F.col("_seg") + 1).alias("segment"), F.lit(0).cast("long").alias("part"))
    places = F.array_compact(
        F.array(F.when(F.col("_loud") | tail, own), F.when(lead_in & F.lit(preroll > 1), ahead))
    )
    return (
        b.withColumn("_at", F.explode(places))
        .withColumns({"segment": F.col("_at.segment"), "part": F.col("_at.part")})
        .drop("_loud", "_was", "_next", "_no", "_start", "_first_no", "_seg", "_from", "_at")
    )


def segment_chunks(
    segment_frames: DataFrame, key: str, frame_ms: int = 200, min_ms: int = 300, min_rms: float = 0.005
) -> DataFrame:
    """Chunks sent per segment part, with those too short or too quiet left out."""
    per = segment_frames.groupBy(key, "segment", "part").agg(
        F.count(F.lit(1)).alias("frames"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("chunk_rms")
    )
    return per.where((F.col("frames") * frame_ms >= min_ms) & (F.col("chunk_rms") >= min_rms))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements two arrays share."""
    n = F.when(a.isNull() | b.isNull(), 0).otherwise(F.least(F.size(a), F.size(b)))
    at = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(a, i) == F.get(b, i))
    miss = F.array_position(at, F.lit(False))
    return F.when(n <= 0, 0).when(miss == 0, n).otherwise(miss - 1).cast("long")


def stable_commits(df: DataFrame, key: str = "utt_id", order: str = "pass_no") -> DataFrame:
    """Sentences committed by each hypothesis: those in the common prefix of two hypotheses in a row;
    the final pass commits the rest. Rejected hypotheses must be removed before."""
    sizes = group_sizes(df, [key])
    lagged = with_scans(df, [key], [order], {"_prev": Lag(F.col("sentences"))}, sizes=sizes)
    stable = F.coalesce(common_prefix(F.col("_prev"), F.col("sentences")), F.lit(0))
    reach = F.when(F.col("is_final"), F.size("sentences").cast("long")).otherwise(stable)
    got = with_scans(
        lagged.withColumn("_reach", reach), [key], [order], {"_done": RunMax(F.col("_reach"), inclusive=False)}, sizes=sizes
    )
    before = F.coalesce("_done", F.lit(0)).cast("int")
    new = F.when(
        F.col("_reach") > before, F.slice("sentences", before + 1, (F.col("_reach") - before).cast("int"))
    ).otherwise(F.slice("sentences", 1, 0))
    return got.withColumns(
        {"committed": new, "first_sub_seq": before, "committed_total": F.greatest(F.col("_reach"), before.cast("long"))}
    ).drop("_prev", "_reach", "_done")


def event_sequence(df: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Order numbers from 1. Without keys the number is global: blocks are numbered alone and
    shifted by the counts before them."""
    return with_scans(df, keys or [], order, {"event_seq": RowNumber()})


def sequence_gaps(df: DataFrame, key: str, order: list[str], seq: str = "event_seq") -> DataFrame:
    """For each receiver: numbers missing before this row and whether it repeats the last one."""
    out = with_scans(df, [key], order, {"_prev": Lag(F.col(seq))})
    step = F.col(seq) - F.col("_prev")
    return out.withColumns(
        {
            "missing": F.coalesce(F.greatest(step - 1, F.lit(0)), F.lit(0)).cast("long"),
            "duplicate": F.coalesce(step <= 0, F.lit(False)),
        }
    ).drop("_prev")


def latest_per_key(df: DataFrame, keys: list[str], values: list[str], ts: list[str]) -> DataFrame:
    """Last non-null value of each column per key."""
    at = F.struct(*ts)
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(v) for v in values]
    )


def every_nth(df: DataFrame, high_rate: list[str], order: list[str], n: int = 10, kind: str = "type") -> DataFrame:
    """Each n-th row of high-rate types, all rows of the rest."""
    busy = with_scans(df.where(F.col(kind).isin(high_rate)), [kind], order, {"_no": RowNumber()})
    rest = df.where(~F.col(kind).isin(high_rate))
    return busy.where(F.col("_no") % n == 0).drop("_no").unionByName(rest)


def after_last_clear(
    df: DataFrame, board: list[str], seq: str = "seq", kind: str = "type", start: str = "lecture_start"
) -> DataFrame:
    """Draw events of a board after its last clear and after the last lecture start. The two marks are
    aggregates per board and per slide, joined back, so no board is gathered in one place."""
    resets = df.where(F.col(kind).isin("draw_clear", start))
    clears = resets.where(F.col(kind) == "draw_clear").groupBy(*board).agg(F.max(seq).alias("_clear"))
    starts = resets.where(F.col(kind) == start).groupBy(board[0]).agg(F.max(seq).alias("_start"))
    draws = df.where(~F.col(kind).isin("draw_clear", start))
    return (
        draws.join(clears, board, "left").join(starts, board[0], "left")
        .where(F.col(seq) > F.greatest(F.coalesce("_clear", F.lit(-1)), F.coalesce("_start", F.lit(-1))))
        .drop("_clear", "_start")
    )


def drawings_replay(df: DataFrame, current: DataFrame, board: list[str]) -> DataFrame:
    """Surviving events of the slide a late joiner sees; ``current`` names that slide per session."""
    return after_last_clear(df, board).join(current, board[0], "left_semi")


def attach_stroke_page(df: DataFrame, keys: list[str], order: list[str], strict: bool = False) -> DataFrame:
    """Points and ends carry no page: they take it from the begin before them. ``strict`` drops events
    without a page instead, as a store keyed by page would."""
    if strict:
        return df.where(F.col("page").isNotNull())
    out = with_scans(
        df, keys, order, {"_page": LastSeen(F.when(F.col("type") == "draw_begin", F.col("page")))}
    )
    return out.withColumn("page", F.coalesce("page", "_page")).drop("_page")


def assemble_strokes(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Strokes from begin, point and end events, one row per finished stroke, plus erase actions.

    A begin discards an open stroke; points and the end must carry its id. A rectangle keeps its first
    and last point and needs one; other tools need one point. A clear of the page discards an open
    stroke. Events are keyed by the running number of begins, so a stroke is one small group.
    """
    reset = F.when(F.col("type").isin("draw_begin", "draw_clear"), F.struct(
        F.when(F.col("type") == "draw_begin", F.col("id")).alias("id"),
        F.when(F.col("type") == "draw_begin", F.col("tool")).alias("tool"),
        F.when(F.col("type") == "draw_begin", F.col("color")).alias("color"),
        F.when(F.col("type") == "draw_begin", F.col("page")).alias("page"),
    ))
    marks = with_scans(
        df, keys, order,
        {
            "_stroke": RunSum(F.col("type").isin("draw_begin", "draw_clear").cast("long")),
            "_open": LastSeen(reset),
            "_ended": RunSum((F.col("type") == "draw_end").cast("long"), inclusive=False),
        },
    )
    at = F.struct(*order)
    mine = marks.where(
        F.col("type").isin("draw_point", "draw_end") & (F.col("_open.id") == F.col("id"))
    )
    # Only events up to the first end of the stroke count.
    ends = mine.where(F.col("type") == "draw_end").groupBy(*keys, "_stroke").agg(F.min(at).alias("_end"))
    inside = mine.where(F.col("type") == "draw_point").join(ends, [*keys, "_stroke"]).where(at < F.col("_end"))
    strokes = inside.groupBy(*keys, "_stroke").agg(
        F.count(F.lit(1)).alias("points"),
        F.first("_open").alias("_o"),
        F.min_by(F.struct("x", "y"), at).alias("_a"),
        F.max_by(F.struct("x", "y"), at).alias("_z"),
        F.max("_end").alias("_end"),
    )
    drawn = strokes.select(
        *keys, F.col("_o.page").alias("page"),
        F.when(F.col("_o.tool") == "rect", "rect").otherwise("stroke").alias("kind"),
        F.col("_o.id").alias("id"), F.col("_o.tool").alias("tool"), F.col("_o.color").alias("color"), "points",
        F.col("_a.x").alias("x_first"), F.col("_a.y").alias("y_first"),
        F.col("_z.x").alias("x_last"), F.col("_z.y").alias("y_last"),
        *[F.col(f"_end.{o}").alias(o) for o in order],
    )
    erased = df.where(F.col("type") == "draw_erase").select(
        *keys, "page", F.lit("erase").alias("kind"), "id", F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("string").alias("color"), F.lit(1).cast("long").alias("points"),
        F.col("x").alias("x_first"), F.col("y").alias("y_first"), F.col("x").alias("x_last"), F.col("y").alias("y_last"),
        *order,
    )
    return drawn.unionByName(erased)


def stroke_points(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The points of each open stroke in order, one row per point, for drawing."""
    sizes = group_sizes(df, keys)
    marks = with_scans(
        df, keys, order, {"stroke_no": RunSum(F.col("type").isin("draw_begin", "draw_clear").cast("long"))}, sizes=sizes
    )
    points = marks.where(F.col("type") == "draw_point")
    return with_scans(points, [*keys, "stroke_no"], order, {"point_no": RowNumber()}, sizes=sizes)


def lecture_sessions(
    df: DataFrame, key: str, order: list[str], ts: str = "ts_ms", grace_ms: int = 30_000
) -> DataFrame:
    """Sessions from start, end, disconnect and reconnect events.

    A session ends at its end event, at a new start (stale), or 30 s after a disconnect that no
    other event follows in time. Only marks that open or close are aggregated per session.
    """
    sizes = group_sizes(df, [key])
    a = with_scans(df, [key], order, {"_next_ts": Lead(F.col(ts))}, sizes=sizes)
    # Any later event within the grace period (a return, an end, a new start) stops the timer.
    alone = F.coalesce(F.col("_next_ts") - F.col(ts) > grace_ms, F.lit(True))
    lost = (F.col("type") == "disconnect") & alone
    closes = F.when(F.col("type") == "end", F.col(ts)).when(lost, F.col(ts) + grace_ms)
    b = a.withColumns({"_starts": (F.col("type") == "start").cast("long"), "_close": closes})
    c = with_scans(b, [key], order, {"session_no": RunSum(F.col("_starts"))}, sizes=sizes).where("session_no > 0")
    how = F.when(F.col("type") == "end", "end").when(F.col("_close").isNotNull(), "timeout")
    spans = c.groupBy(key, "session_no").agg(
        F.min(F.when(F.col("type") == "start", F.col(ts))).alias("start_ms"),
        F.min_by(F.struct(F.col("_close").alias("at"), how.alias("how")), F.when(F.col("_close").isNotNull(), F.struct("_close", *order))).alias("_end"),
    )
    following = with_scans(spans, [key], ["session_no"], {"_stale": Lead(F.col("start_ms"))}, sizes=sizes)
    return following.select(
        key, "session_no", "start_ms",
        F.coalesce(F.col("_end.at"), F.col("_stale")).alias("end_ms"),
        F.coalesce(F.col("_end.how"), F.when(F.col("_stale").isNotNull(), "stale"), F.lit("open")).alias("ended_by"),
    )


def pause_durations(df: DataFrame, key: str, order: list[str], ts: str = "ts_ms") -> DataFrame:
    """Length of each pause at its resume and what remains of it on a viewer that saw the pause
    ``applied_ms`` and the resume ``seen_ms`` (optional columns)."""
    last = F.when(F.col("type") == "pause", F.col(ts)).when(F.col("type") == "resume", F.lit(-1))
    seen = with_scans(df, [key], order, {"_pause": LastSeen(last, inclusive=False)})
    paused = F.when(F.col("_pause") >= 0, F.greatest(F.col(ts) - F.col("_pause"), F.lit(0))).otherwise(F.lit(0))
    return seen.where("type = 'resume'").withColumn("pause_ms", paused.cast("long")).drop("_pause")


def pause_remaining(df: DataFrame, elapsed: str = "elapsed_ms") -> DataFrame:
    return df.withColumn("remaining_ms", F.greatest(F.col("pause_ms") - F.col(elapsed), F.lit(0)))


def suppress_repeats(
    df: DataFrame, key: str, order: list[str], ts: str = "ts_ms", courtesy: str = P.COURTESY,
    window_ms: int = 30_000, max_chars: int = 15, col: str = "text",
) -> DataFrame:
    """Drop a short courtesy text said again within 30 s of the last accepted one; another courtesy
    text resets. Adds ``suppressed``.

    Rows are first cut where a decision cannot depend on the past: at another text and at a silence
    of 30 s. Only what is left, a dense run of one text, is walked in order, each run alone.
    """
    short = (F.length(col) < max_chars) & F.col(col).rlike(courtesy)
    said = df.where(short)
    sizes = group_sizes(said, [key])
    lagged = with_scans(said, [key], order, {"_pt": Lag(F.col(col)), "_pts": Lag(F.col(ts))}, sizes=sizes)
    fresh = ~F.coalesce((F.col("_pt") == F.col(col)) & (F.col(ts) - F.col("_pts") < window_ms), F.lit(False))
    runs = with_scans(lagged.withColumn("_new", fresh.cast("long")), [key], order, {"_run": RunSum(F.col("_new"))}, sizes=sizes)

    def first():
        return None

    def move(accepted, row):
        (at,) = row
        if accepted is not None and at - accepted < window_ms:
            return accepted, (True,)
        return at, (False,)

    fold = Sequential((ts,), [T.StructField("suppressed", T.BooleanType())], first, move)
    judged = ordered_fold(runs.drop("_pt", "_pts", "_new"), [key, "_run"], order, fold).drop("_run")
    rest = df.where(~F.coalesce(short, F.lit(False))).withColumn("suppressed", F.lit(False))
    return judged.unionByName(rest)


def link_quality(df: DataFrame, key: str, connection: str, order: list[str]) -> DataFrame:
    """Loss per report from cumulative counters; a new connection starts from zero."""
    out = with_scans(
        df, [key], order,
        {"_r": Lag(F.col("received")), "_l": Lag(F.col("lost")), "_c": Lag(F.col(connection))},
    )
    same = F.coalesce(F.col("_c") == F.col(connection), F.lit(False))
    got = F.greatest(F.col("received") - F.when(same, F.col("_r")).otherwise(F.lit(0)), F.lit(0))
    gone = F.greatest(F.col("lost") - F.when(same, F.col("_l")).otherwise(F.lit(0)), F.lit(0))
    out = out.withColumns({"delta_received": got, "delta_lost": gone}).drop("_r", "_l", "_c")
    total = F.col("delta_received") + F.col("delta_lost")
    loss = F.when(total > 0, F.col("delta_lost") / total * 100).otherwise(0.0)
    return out.withColumn("loss_percent", loss).withColumn(
        "quality",
        F.when(F.col("delta_received") == 0, "offline")
        .when(F.col("loss_percent") < 1, "good")
        .when(F.col("loss_percent") < 5, "fair")
        .otherwise("poor"),
    )


def stage_baseline(stage: Column, baselines: dict[str, float] = P.STAGE_BASELINES) -> Column:
    out = F.lit(P.OTHER_STAGE_BASELINE)
    for name, seconds in baselines.items():
        out = F.when(stage == name, seconds).otherwise(out)
    return out


def page_ema(
    df: DataFrame, keys: list[str], order: list[str], duration: str = "seconds", stage: str = "stage",
    baselines: dict[str, float] = P.STAGE_BASELINES,
) -> DataFrame:
    """Average page time of a stage: the first page is half baseline and half measured, then
    0.75 * previous + 0.25 * measured. An average of exactly 0 counts as not started."""
    sizes = group_sizes(df, keys)
    n = with_scans(df, keys, order, {"_n": RowNumber()}, sizes=sizes)
    d = F.greatest(F.col(duration), F.lit(0.0))
    base = F.when(F.col(stage).isin(*baselines), stage_baseline(F.col(stage), baselines)).otherwise(d)
    first = F.col("_n") == 1
    coef = n.withColumns(
        {
            "_a": F.when(first, 0.0).otherwise(0.75),
            "_b": F.when(first, base * 0.5 + d * 0.5).otherwise(d * 0.25),
            "_lo": F.lit(-INF),
            "_hi": F.lit(INF),
        }
    )
    return ordered_fold(coef, keys, order, Affine(("_a", "_b", "_lo", "_hi"), "avg_seconds"), sizes=sizes).drop(
        "_a", "_b", "_lo", "_hi", "_n"
    )


def stage_eta(df: DataFrame, baselines: dict[str, float] = P.STAGE_BASELINES, bundling: float = P.BUNDLING_SECONDS) -> DataFrame:
    """Remaining seconds from stage, stage_total, stage_current, avg_seconds and elapsed; null outside
    the active stages. The first stage adds the next one's baseline for all pages and the bundling."""
    left = F.greatest(F.col("stage_total") - F.col("stage_current"), F.lit(0))
    per = F.when(F.col("avg_seconds") > 0, F.col("avg_seconds")).otherwise(stage_baseline(F.col("stage"), baselines))
    own = F.when(left > 0, (per - F.col("elapsed")) + per * (left - 1)).otherwise(0.0)
    after = F.col("stage_total") * baselines["translate"] + bundling
    eta = (
        F.when(F.col("stage") == "ocr", own + after)
        .when(F.col("stage") == "translate", own)
        .when(F.col("stage") == "bundling", F.lit(bundling) - F.col("elapsed"))
    )
    return df.withColumn("eta_seconds", F.when(eta.isNotNull(), F.greatest(eta, F.lit(0.0))))


def pack_chunks(blocks: DataFrame, group: list[str], page: str = "page", n: int = 15) -> DataFrame:
    """Pages packed in order into chunks of at most ``n`` blocks; a page is never divided and groups
    (sources) are packed apart. Adds ``chunk_no`` to every block.

    The fold runs over page counts, not blocks, and its state is only how full the open chunk is.
    """
    counts = blocks.groupBy(*group, page).agg(F.count(F.lit(1)).alias("_n"))

    def move(fill, row):
        size = int(row[0])
        closed = 1 if fill and fill + size > n else 0
        fill = size if closed else fill + size
        full = fill >= n
        # The flag says the page filled its chunk, so the next page opens another one.
        return (0 if full else fill), closed + (1 if full else 0), (1 if full else 0)

    fold = Automaton(("_n",), ("_closed", "_full", "_fill"), n + 1, move)
    packed = ordered_fold(counts, group, [page], fold)
    chunk = packed.select(*group, page, (F.col("_closed") - F.col("_full")).alias("chunk_no"))
    return blocks.join(chunk, [*group, page])


def peak_hold(
    df: DataFrame, keys: list[str], order: list[str], level: str = "db", start: float = -60.0,
    hold: int = 30, decay: float = 0.7,
) -> DataFrame:
    """Running peak that falls 0.7 per frame once 30 frames brought no new peak. One capture at a
    time, in order; memory is two numbers."""

    def first():
        return (start, 0)

    def move(state, row):
        peak, idle = state
        (db,) = row
        if db > peak:
            peak, idle = db, 0
        else:
            idle += 1
            if idle > hold:
                peak -= decay
        return (peak, idle), (peak,)

    return ordered_fold(df, keys, order, Sequential((level,), [T.StructField("peak_db", T.DoubleType())], first, move))


def frame_batches(
    df: DataFrame, keys: list[str], order: list[str], level: str = "rms", every: int = 3,
    quiet_after: int = 2, quiet: float = 0.008,
) -> DataFrame:
    """Which frames trigger processing: every third, or the second when the newest is silent. Adds
    ``fires`` and ``batch_no`` (of the batch the frame belongs to)."""

    def move(since, row):
        since += 1
        fire = since >= every or (since >= quiet_after and row[0] < quiet)
        return (0 if fire else since), (1 if fire else 0), (1 if fire else 0)

    fold = Automaton((level,), ("_fired", "_flag", "_since"), every + 1, move)
    out = ordered_fold(df, keys, order, fold)
    return out.withColumns(
        {"fires": F.col("_flag") == 1, "batch_no": F.col("_fired") - F.col("_flag") + 1}
    ).drop("_fired", "_flag", "_since")


def audience_size(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Connected viewers after each join (+1) or leave (-1)."""
    step = F.when(F.col("type") == "join", 1).when(F.col("type") == "leave", -1).otherwise(0)
    return with_scans(df.withColumn("_d", step.cast("long")), [key], order, {"audience": RunSum(F.col("_d"))}).drop("_d")
