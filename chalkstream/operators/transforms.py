"""Text and box transforms as table jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import boxes, clock
from ..functions import text as T
from ..functions.generate import rows_of

_INLINE = "mark|b|i|em|strong|u|s|sub|sup|span|div|font"
_SYMBOL_CHAR = r"[\p{So}\p{Sm}\p{Sk}\x{2600}-\x{27BF}\x{1F300}-\x{1F9FF}]"
_LISTED = f"(?:[{P.PREFIX_SYMBOLS}]|[>\\-](?= ))"
_TEXT_CHAR = r" \t\n.,;:!?'\"()\[\]{}/<>@#$%^&*+=_\-~`\\|\p{Nd}A-Za-z\uac00-\ud7af\u1100-\u11ff\u3130-\u318f"


def without_tags(c: Column) -> Column:
    """Tags removed (math is kept), whitespace collapsed."""
    c = F.regexp_replace(c, rf"(?i)</?(?:{_INLINE})[^>]*>", "")
    c = F.regexp_replace(c, r"(?i)</?(?!math)[a-z][^>]*>", "")
    return T.squeeze(F.regexp_replace(c, r"<[^>]+/>", ""))


def without_math(c: Column) -> Column:
    """Formulas become arrows, neighbouring arrows one."""
    c = F.regexp_replace(c, r"(?s)<math>.*?</math>", " → ")
    c = F.regexp_replace(c, r"<math>[^<]*", " → ")
    c = F.regexp_replace(c, r"\\(?:frac|sum|int|sqrt|rightarrow|leftarrow)\b[^a-zA-Z]*", " ")
    c = F.regexp_replace(c, r"\s+", " ")
    return F.trim(F.regexp_replace(c, r"(?:→\s*)+", "→ "))


def strip_markup(df: DataFrame, col: str = "text", math: bool = False) -> DataFrame:
    c = without_tags(F.col(col))
    return df.withColumn("plain", without_math(c) if math else c)


def normalized(c: Column) -> Column:
    """Typographic quotes, dashes, spaces, dots, arrows and full-width marks to plain ASCII."""
    c = F.translate(c, *P.ONE_TO_ONE)
    for old, new in P.ONE_TO_MANY:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_unicode(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("normalized", normalized(F.col(col)))


def split_prefix(
    df: DataFrame, col: str = "text", rendered: list[str] = P.RENDERED_PREFIXES,
    preserved: list[str] = P.PRESERVED_PREFIXES, default_policy: str = "render",
) -> DataFrame:
    """Leading bullet, checkbox or emoji apart from the content, and how to treat it."""
    t = T.strip(F.col(col))
    listed = t.rlike(f"^{_LISTED}")
    rest = T.strip(F.regexp_replace(t, r"^(?s:.)", ""))
    symbol = t.rlike(f"^{_SYMBOL_CHAR}") & (rest != "")
    has = listed | symbol
    first = F.regexp_extract(t, r"^((?s:.))", 1)
    out = df.withColumns(
        {
            "prefix": F.when(has, F.concat(first, F.lit(" "))).otherwise(""),
            "content": F.when(has, rest).otherwise(t),
        }
    )
    mark = F.trim("prefix")

    def starts(options: list[str]) -> Column:
        return T.any_of([mark.startswith(o) for o in options])

    return out.withColumn(
        "prefix_policy",
        F.when(mark == "", "none").when(starts(rendered), "render").when(starts(preserved), "preserve").otherwise(default_policy),
    )


def restored(prefix: Column, translated: Column) -> Column:
    t = T.strip(translated)
    t = T.strip(F.regexp_replace(t, f"^{_LISTED}", ""))
    t = T.strip(F.regexp_replace(t, f"^{_SYMBOL_CHAR}", ""))
    return F.when(F.coalesce(prefix, F.lit("")) == "", translated).otherwise(F.concat(prefix, t))


def restore_prefix(df: DataFrame) -> DataFrame:
    """Original prefix back on the translation, in place of any the model added."""
    return df.withColumn("restored", restored(F.col("prefix"), F.col("translated")))


def separate_prefix(df: DataFrame, col: str = "text") -> DataFrame:
    """Leading symbols (no letter or digit) apart from the text, with their estimated width."""
    # The prefix ends at the first letter, or after the first space that follows a symbol.
    symbols = r"^([^ \ta-zA-Z0-9\uac00-\ud7af\u1100-\u11ff\u3130-\u318f]+[ \t]?)"
    p = F.regexp_extract(F.col(col), symbols, 1)
    width = F.length(F.regexp_replace(p, r"[ \t]", "")) * F.col("size") * 0.8
    rest = F.regexp_replace(F.expr(f"substring({col}, length(_p) + 1)"), r"^\s+", "")
    return (
        df.withColumn("_p", p)
        .withColumns(
            {
                "symbol_prefix": F.col("_p"),
                "symbol_width": F.when(F.col("_p") == "", 0.0).otherwise(width),
                "text_without_prefix": F.when(F.col("_p") == "", F.col(col)).otherwise(rest),
            }
        )
        .drop("_p")
    )


def _spread(df: DataFrame, pieces: Column) -> DataFrame:
    """Explode text pieces that cover a text end to end, each with its share of the box."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, p: Column) -> Column:
        return F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))

    out = (
        df.withColumn("_pieces", pieces).withColumn("_run", F.aggregate("_pieces", none, step))
        .withColumn("_z", F.arrays_zip(F.col("_pieces").alias("piece"), F.col("_run.starts").alias("at")))
        .withColumn("_total", F.col("_run.at"))
    )
    out = rows_of(out, F.col("_z"), "piece_no", "_z1", [*df.columns, "_total"]).withColumns(
        {"piece": F.col("_z1.piece"), "_at": F.col("_z1.at")}
    )
    step_width, x0 = boxes.width() / F.col("_total"), F.col("x0")
    return out.withColumns(
        {"piece_x0": x0 + F.col("_at") * step_width, "piece_x1": x0 + (F.col("_at") + F.length("piece")) * step_width}
    ).drop("_z1", "_at", "_total")


def split_wide_gaps(df: DataFrame, col: str = "text", gap: int = 8) -> DataFrame:
    """Text divided at wide gaps; the box is shared in proportion to the parts' lengths."""
    parts = F.filter(F.transform(F.split(F.col(col), rf"\s{{{gap},}}"), lambda p: T.strip(p)), lambda p: p != "")
    return _spread(df, parts)


def split_arrows(df: DataFrame, col: str = "text", arrows: list[str] = P.ARROWS) -> DataFrame:
    """Text divided at each arrow; every piece gets its share of the box and a flag."""
    marks = "".join("\\" + a if a in "-[]^\\" else a for a in arrows)
    pieces = F.regexp_extract_all(F.col(col), F.lit(f"([{marks}]|[^{marks}]+)"), F.lit(1))
    out = _spread(df, pieces)
    return out.withColumn("is_arrow", F.col("piece").isin(arrows)).where(
        F.col("is_arrow") | (T.strip(F.col("piece")) != "")
    )


def split_symbols(df: DataFrame, col: str = "text", text_chars: str = _TEXT_CHAR) -> DataFrame:
    """Text divided between runs of text characters and runs of symbols."""
    pieces = F.regexp_extract_all(F.col(col), F.lit(f"([{text_chars}]+|[^{text_chars}]+)"), F.lit(1))
    out = _spread(df, pieces).where(T.strip(F.col("piece")) != "")
    return out.withColumn("is_symbol", ~F.col("piece").rlike(f"^[{text_chars}]"))


def without_symbols(c: Column, text_chars: str = _TEXT_CHAR) -> Column:
    """Inline symbols become single spaces."""
    return F.regexp_replace(F.regexp_replace(c, f"[^{text_chars}]", " "), " +", " ")


def split_breaks(df: DataFrame, col: str = "text") -> DataFrame:
    """Non-blank lines between break tags, numbered from 0; text without a break stays whole."""
    c = F.col(col)
    parts = F.filter(F.transform(F.split(c, r"(?i)<br\s*/?>"), lambda p: T.strip(p)), lambda p: p != "")
    lines = F.when(F.lower(c).contains("<br>"), parts).otherwise(F.array(c))
    return rows_of(df, lines, "line_no", "line")


def join_breaks(df: DataFrame, keys: list[str], line: str = "line", pos: str = "line_no") -> DataFrame:
    """Lines of one region back on one line, by `` / ``."""
    rows = F.sort_array(F.collect_list(F.struct(pos, line)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[line]), " / ").alias("joined"))


def sentences(c: Column) -> Column:
    """Split after . ? ! and whitespace; a text without a break stays whole."""
    t = T.strip(c)
    return F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda p: p != "")


def split_sentences(df: DataFrame, col: str = "text") -> DataFrame:
    return rows_of(df, sentences(F.col(col)), "sentence_no", "sentence")


def phrases(c: Column, max_words: int = 4, breaks: str = r"(?<=[,;.!?])\s+", space: str = r"\s+") -> Column:
    """Parts between ``breaks``, each cut into runs of at most ``max_words`` words."""
    parts = F.transform(F.split(c, breaks), lambda p: T.words(p, space))

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(max_words))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(max_words)), " "))

    return F.filter(F.flatten(F.transform(parts, runs)), lambda p: p != "")


def split_phrases(
    df: DataFrame, col: str = "text", max_words: int = 4, breaks: str = r"(?<=[,;.!?])\s+", space: str = r"\s+", whole: bool = True
) -> DataFrame:
    """One row per phrase; a text without any stays whole, or has no row if not ``whole``."""
    found = phrases(F.col(col), max_words, breaks, space)
    if not whole:
        return rows_of(df, found, "phrase_no", "phrase")
    out = df.select("*", F.posexplode_outer(found).alias("phrase_no", "phrase"))
    return out.withColumns(
        {"phrase_no": F.coalesce("phrase_no", F.lit(0)), "phrase": F.coalesce("phrase", F.col(col))}
    )


def quoted_strings(df: DataFrame, col: str = "text", script: str = P.HANGUL) -> DataFrame:
    """Quoted strings that hold the source script."""
    pattern = f"[\"']([^\"']*?[{script}]+[^\"']*?)[\"']"
    return rows_of(df, F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(1)), "quote_no", "quoted")


def time_format(df: DataFrame, col: str = "t_offset") -> DataFrame:
    return df.withColumns(
        {"srt_time": clock.srt_time(F.col(col)), "minute_time": clock.minute_time(F.col(col))}
    )


_FIT = "box_no int, size double, spare double"


def _spare(ends: np.ndarray, first: np.ndarray, last: np.ndarray, width: np.ndarray, height: np.ndarray, size: np.ndarray,
           char_width: float, line_height: float) -> np.ndarray:
    """Height left by a greedy wrap at spaces, negative as soon as the lines so far do not fit; a word wider than the box
    takes a line of its own. ``ends`` are running sums of word lengths with one space each, words ``first`` to ``last`` of a text."""
    per_char = size * char_width
    most = np.floor(width / per_char)
    # The division rounds: the characters that fit are those whose product does.
    most = np.where((most + 1) * per_char <= width, most + 1, np.where(most * per_char > width, most - 1, most))
    chars = np.clip(np.nan_to_num(most, nan=0.0), 0, ends[-1] + 1).astype("int64")
    at, lines, left = first.copy(), np.zeros(len(first)), height.copy()
    todo = np.flatnonzero(at < last)
    while todo.size:
        start = at[todo]
        stop = np.searchsorted(ends, ends[start] + chars[todo] + 1, "right") - 1
        at[todo] = stop = np.minimum(np.maximum(stop, start + 1), last[todo])
        lines[todo] += 1
        left[todo] = height[todo] - lines[todo] * size[todo] * line_height
        todo = todo[(stop < last[todo]) & ~(left[todo] < 0)]
    return left


def _first_fits(char_width: float, line_height: float, shrink: float):
    """The first box and the first size that hold a text, for a batch of rows. As in Spark, NaN is above all numbers; null is
    below all."""

    def values(c: pa.Array) -> np.ndarray:
        return c.fill_null(float("-inf")).to_numpy(zero_copy_only=False).astype("float64")

    @F.arrow_udf(_FIT)
    def fit(
        words: pa.Array, size: pa.Array, least: pa.Array, width: pa.Array, wide: pa.Array, height: pa.Array, high: pa.Array,
        grow: pa.Array,
    ) -> pa.Array:
        counts = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        last = np.cumsum(counts, dtype="int64")
        first = last - counts
        ends = np.concatenate([[0], np.cumsum(words.flatten().to_numpy(zero_copy_only=False).astype("int64") + 1)])
        size, least, width, wide, height, high = map(values, (size, least, width, wide, height, high))
        with np.errstate(all="ignore"):
            steps = np.floor(np.log(size / least) / -np.log(shrink))
            k = np.where(np.isfinite(steps) & (size >= least), steps, 0).astype("int64")
            powers = np.array([shrink**i for i in range(int(k.max(initial=0)) + 2)])
            # The logarithm rounds: a step counts if its size is not below the least.
            k = np.where(np.isfinite(steps) & (size * powers[k + 1] >= least), k + 1, k)
            k = np.where((k > 0) & (size * powers[k] < least), k - 1, k)
            shrunk = np.where(size < least, 0, k + 1)
            end = np.where((shrunk > 0) & (size * powers[np.maximum(shrunk - 1, 0)] == least), shrunk - 1, shrunk)

            def size_at(rows: np.ndarray, step: np.ndarray) -> np.ndarray:
                return np.where(step < shrunk[rows], size[rows] * powers[np.minimum(step, len(powers) - 1)], least[rows])

            def spare(rows: np.ndarray, step: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return _spare(
                    ends, first[rows], last[rows], x[rows], y[rows], size_at(rows, step), char_width, line_height
                )

            box_no, found = np.full(len(size), -1, "int32"), np.zeros(len(size), "int64")
            boxes_of = [(width, height), (wide, height), (wide, high)]
            more = np.flatnonzero(grow.fill_null(False).to_numpy(zero_copy_only=False))
            for no, (x, y) in enumerate(boxes_of):
                rows = np.arange(len(size)) if no == 0 else more[box_no[more] < 0]
                # Smaller text never needs more room: where the smallest size fails, no size fits, and the first that fits is
                # found by halving.
                fits = ~(spare(rows, np.zeros(len(rows), "int64"), x, y) < 0)
                box_no[rows[fits]] = no
                rows = rows[~fits]
                rows = rows[~(spare(rows, end[rows], x, y) < 0)]
                box_no[rows] = no
                lo, hi = np.minimum(1, end[rows]), end[rows].copy()
                while (open_ := np.flatnonzero(lo < hi)).size:
                    half = (lo[open_] + hi[open_]) // 2
                    ok = ~(spare(rows[open_], half, x, y) < 0)
                    hi[open_[ok]] = half[ok]
                    lo[open_[~ok]] = half[~ok] + 1
                found[rows] = lo
            every = np.arange(len(size))
            x = np.where(box_no > 0, wide, width)
            left = spare(every, found, x, np.where(box_no == 2, high, height))
        parts = [pa.array(box_no), pa.array(size_at(every, found)), pa.array(left)]
        return pa.StructArray.from_arrays(parts, ["box_no", "size", "spare"], mask=pa.array(box_no < 0))

    return fit


def fit_audit(
    df: DataFrame, char_width: float = 0.65, line_height: float = 1.3, shrink: float = 0.9,
    min_sizes: dict[str, float] = P.MIN_FONT_SIZE, ratios: dict[str, tuple[float, float]] = P.EXPAND_RATIO,
    margin: float = 10.0,
) -> DataFrame:
    """Whether a text fits its box: own box, widened, widened and heightened; sizes shrink by a tenth
    down to the role's minimum. The first fit is reported, else the last box at the minimum size.

    All candidates of a block are tried beside its row, a batch of rows at once: no explode, no shuffle.
    """
    role = F.coalesce(F.col("role"), F.lit("default"))

    def by_role(values: dict[str, float]) -> Column:
        out = F.lit(values["default"])
        for name, v in values.items():
            out = F.when(role == name, v).otherwise(out)
        return out

    smallest = by_role(min_sizes)
    right = by_role({k: v[0] for k, v in ratios.items()})
    down = by_role({k: v[1] for k, v in ratios.items()})
    base = df.withColumns(
        {
            "_min": smallest,
            "_r": F.least(F.col("x1") + boxes.width() * right, F.col("page_width") - margin),
            "_d": F.least(F.col("y1") + boxes.height() * down, F.col("page_height") - margin),
        }
    )
    fit = _first_fits(char_width, line_height, shrink)(
        F.transform(T.words(F.col("text")), F.length), F.col("size").cast("double"), F.col("_min").cast("double"),
        *[(F.col(to) - F.col(since)).cast("double") for to, since in (("x1", "x0"), ("_r", "x0"), ("y1", "y0"), ("_d", "y0"))],
        F.col("expand_allowed"),
    )
    base = base.withColumn("_fit", fit)
    box = F.col("_fit.box_no")
    grow = F.col("expand_allowed")
    return base.withColumns(
        {
            "fits": box.isNotNull(),
            "fit_box": F.coalesce(box, F.when(grow, 2).otherwise(0)),
            "fit_x1": F.when(F.coalesce(box > 0, grow), F.col("_r")).otherwise(F.col("x1")),
            "fit_y1": F.when(F.coalesce(box == 2, grow), F.col("_d")).otherwise(F.col("y1")),
            "fit_size": F.coalesce("_fit.size", F.col("_min")),
            "fit_spare": F.coalesce("_fit.spare", F.lit(-1.0)),
        }
    ).drop("_min", "_r", "_d", "_fit")
