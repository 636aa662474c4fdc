"""Filters and quality gates.

A gate adds ``kept`` (boolean) and ``reason`` (name of the first rule that fired, null if kept) and
keeps all rows, so that what was dropped can be counted; ``kept_rows`` filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import audio, boxes
from ..functions import text as T
from ..plans.scans import Lag, with_scans
from .terms import holds_any, remove_terms, with_holds_any


def gate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("reason", T.first_reason(rules)).withColumn("kept", F.col("reason").isNull())


def kept_rows(df: DataFrame) -> DataFrame:
    return df.where("kept").drop("kept", "reason")


def reason_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def gate_asr_segments(
    df: DataFrame,
    stock_phrases: list[str] = P.SPEECH_STOCK_PHRASES,
    courtesy: str | None = P.COURTESY,
    max_compression: float = 2.4,
    max_no_speech: float = 0.4,
    min_logprob: float = -0.8,
    doubtful_no_speech: float = 0.2,
    doubtful_logprob: float = -0.4,
) -> DataFrame:
    """Drop recognised segments by model confidence, stock phrases and doubtful lone courtesies (no such rule without ``courtesy``)."""
    text, quiet, logprob = F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob")
    rules = [
        ("compression", F.col("compression_ratio") > max_compression),
        ("no_speech", quiet > max_no_speech),
        ("logprob", logprob < min_logprob),
        ("stock_phrase", T.matches_any(text, stock_phrases, "i")),
    ]
    if courtesy is not None:
        doubtful = (quiet > doubtful_no_speech) | (logprob < doubtful_logprob)
        rules.append(("courtesy", text.rlike(courtesy) & doubtful))
    return gate(df, rules)


def trim_trailing_boilerplate(df: DataFrame, pattern: str = P.TRAILING_BOILERPLATE) -> DataFrame:
    """Cut a boilerplate tail; texts that were nothing else are dropped."""
    return df.withColumn("text", T.strip(F.regexp_replace("text", pattern, ""))).where("text <> ''")


def gate_utterances(
    df: DataFrame,
    without_terms=None,
    stock_phrases: list[str] = P.SPEECH_STOCK_PHRASES,
    lone_courtesy: str = P.LONE_THANKS,
    max_chars: int = 200,
    min_words: int = 8,
    min_unique: float = 0.3,
    max_ascii: float = 0.6,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Reject noise among recognised utterances. Terms of a dictionary are removed before the ASCII share is
    measured: ``terms`` is a table of any size, ``without_terms`` a function of a column for small ones
    (see ``terms.term_remover``), which streams can use."""
    df = df.withColumn("text", T.strip(F.col("text")))
    text = F.col("text")
    words = T.words(text, r"[\s,]+")
    repetitive = (F.size(words) >= min_words) & (
        F.size(F.array_distinct(words)) / F.size(words) < min_unique
    )
    # Only texts that reach the ASCII rule pay for the dictionary.
    if terms is not None:
        df = remove_terms(df.withColumn("_short", F.when(F.length(text) <= max_chars, text)), terms, "_short", "_cleaned").drop("_short")
    else:
        df = df.withColumn("_cleaned", F.when(F.length(text) <= max_chars, without_terms(text)) if without_terms else text)
    cleaned = F.col("_cleaned")
    ascii_share = T.count_class(cleaned, r"\x00-\x7f") / F.length(cleaned)
    return gate(
        df,
        [
            ("empty", text == ""),
            ("short", F.length(F.replace(text, F.lit(" "), F.lit(""))) < 2),
            ("long", F.length(text) > max_chars),
            ("repeated_unit", text.rlike(r"(.{1,3})\1{3,}")),
            ("repeated_words", repetitive),
            ("ascii", (F.length(cleaned) > 0) & (ascii_share > max_ascii)),
            ("stock_phrase", T.matches_any(text, stock_phrases, "i")),
            ("courtesy", text.rlike(lone_courtesy)),
        ],
    ).drop("_cleaned")


def gate_audio_chunks(df: DataFrame, min_seconds: float = 0.3, min_rms: float = 0.005) -> DataFrame:
    """Reject chunks that are too short or too quiet; needs ``samples`` and ``rate``."""
    return gate(
        df.withColumn("rms", audio.rms(F.col("samples"))).withColumn(
            "seconds", F.size("samples") / F.col("rate")
        ),
        [("short", F.col("seconds") < min_seconds), ("quiet", F.col("rms") < min_rms)],
    )


def gate_mt_input(df: DataFrame, script: str = P.HANGUL, min_script: int = 2) -> DataFrame:
    """Reject texts that make a translation model invent output."""
    text = T.strip(F.col("text"))
    return gate(
        df,
        [
            ("short", F.length(text) < 3),
            ("digits_only", text.rlike(r"^[\d\s\.\,\?\!\-…]+$")),
            ("repeated_char", text.rlike(r"(.)\1{3,}")),
            ("script", T.count_class(text, script) < min_script),
        ],
    )


def gate_mt_output(
    df: DataFrame,
    terms: list[str] | DataFrame | None = None,
    script: str = P.HANGUL,
    target: str = "A-Za-z",
    stock_phrases: list[str] = P.MT_STOCK_PHRASES,
    loop: int | None = 4,
) -> DataFrame:
    """Reject looping, untranslated and stock output. Text that is mostly source script is accepted
    outright when it holds a dictionary term: ``terms`` is a table of any size, or a short list. ``loop`` equal
    words in a row are a loop (None: repeated words are left alone)."""
    text = F.col("text")
    if isinstance(terms, DataFrame):
        df, protected = with_holds_any(df, terms, "_protected"), F.col("_protected")
    else:
        protected = holds_any(text, terms) if terms else F.lit(False)
    source = T.count_class(text, script)
    untranslated = (source > 0) & (source >= T.count_class(text, target))
    return gate(
        df,
        [
            *([("loop", T.same_run(text, loop))] if loop else []),
            ("untranslated", untranslated & ~protected),
            ("stock_phrase", ~untranslated & T.matches_any(text, stock_phrases)),
        ],
    ).drop("_protected")


def _placeholder(text: Column) -> list[tuple[str, Column]]:
    return [
        ("blank", text.isNull() | (T.strip(text) == "")),
        ("punctuation", T.strip(text).rlike(r"^[\?\.\!\s]+$")),
        ("placeholder", T.matches_any(T.strip(text), P.PLACEHOLDERS, "i")),
    ]


def gate_translations(
    df: DataFrame,
    col: str = "text",
    script: str = P.HANGUL,
    max_share: float = 0.3,
    foreign: str = P.OTHER_SCRIPTS,
    strict: bool = True,
) -> DataFrame:
    """Reject placeholders and untranslated text; ``strict=False`` leaves the script rules out."""
    text = F.col(col)
    solid = T.without_space(text)
    rules = [*_placeholder(text), ("no_letters", ~T.has_class(text, f"A-Za-z0-9{script}"))]
    if strict:
        share = T.count_class(solid, script) / F.length(solid)
        rules += [("source_share", share > max_share), ("foreign_script", T.has_class(text, foreign))]
    return gate(df, rules)


def gate_render(
    df: DataFrame, col: str = "text", faults: list[str] = P.RENDER_FAULTS, script: str = P.HANGUL
) -> DataFrame:
    """Last gate before text is drawn; the reason names the fault."""
    text = F.col(col)
    return gate(
        df,
        [
            ("empty_text", text.isNull() | (text == "")),
            *[(f"matched_pattern: {p}", text.rlike(p)) for p in faults],
            ("korean_remaining_in_english", T.has_class(text, script)),
        ],
    )


def flag_prompt_leaks(df: DataFrame, col: str = "response", phrases: list[str] = P.INSTRUCTION_PHRASES) -> DataFrame:
    """Response repeats an instruction phrase."""
    return df.withColumn("leaked", T.contains_any(F.lower(F.coalesce(F.col(col), F.lit(""))), phrases))


def misread_han(text: Column, script: str = P.HANGUL, han: str = P.HAN) -> Column:
    """Stylised script misread as Han characters; the needed share falls with the length."""
    solid = T.without_space(text)
    n, size = T.count_class(text, han), F.length(solid)
    return (
        ~T.has_class(text, script)
        & (n > 0)
        & ((size <= 3) | ((size <= 5) & (n >= size * 0.4)) | (n >= size * 0.6))
    )


def flag_regions(
    df: DataFrame,
    col: str = "text",
    script: str = P.HANGUL,
    han: str = P.HAN,
    code_patterns: list[str] = P.CODE_PATTERNS,
) -> DataFrame:
    """Content flags of recognised regions and their combination ``skip_translate``."""
    text = F.col(col)
    scripted = T.has_class(text, script)
    df = df.withColumns(
        {
            "number_or_latin": ~scripted & text.rlike(r"^[0-9a-zA-Z\s\.,\-_:;!\?@#\$%&\*\(\)\[\]\{\}/\\]+$"),
            "passthrough": ~scripted
            & T.matches_any(
                text,
                [
                    r"[\w\.\-\+]+@[\w\.\-]+\.\w+",
                    r"https?://[\w\.\-/\?=&#]+",
                    r"[A-Za-z]:\\[A-Za-z0-9_\s\\/\.]+|^/[A-Za-z0-9_/\.]+$",
                    r"^\s*[\d\+\-\*/=\(\)\^\s\.]+\s*$",
                ],
            ),
            "has_math": text.rlike(r'<math|</math>|\\frac|\\sum|\\int|\\sqrt|display="'),
            "is_code": T.matches_any(text, code_patterns, "i"),
            "is_single_char": T.strip(text).rlike(f"^[{script}]$"),
            "is_misread": misread_han(T.strip(text), script, han),
        }
    )
    return df.withColumn(
        "skip_translate",
        F.col("number_or_latin")
        | F.col("passthrough")
        | (F.col("has_math") & ~scripted)
        | F.col("is_code")
        | F.col("is_misread"),
    )


def is_symbol_only(text: Column, script: str = P.HANGUL_AND_JAMO) -> Column:
    """Symbols and no letter or digit at all."""
    rest = F.regexp_replace(text, rf"[{script}a-zA-Z0-9\s]", "")
    letters = F.regexp_replace(text, f"[^a-zA-Z0-9{script}]", "")
    return (F.length(rest) > 0) & (F.length(letters) == 0)


def is_connector(text: Column, script: str = P.HANGUL_AND_JAMO) -> Column:
    return T.strip(text).isin(P.CONNECTORS) | is_symbol_only(T.strip(text), script)


def filter_text_lines(
    df: DataFrame, script: str = P.HANGUL_AND_JAMO, jamo: str = P.JAMO, complete: str = "\uac00-\ud7af"
) -> DataFrame:
    """Keep readable lines of the target script inside the page; connectors are kept."""
    text = F.col("text")
    connector = is_connector(text)
    worded = F.length(F.regexp_replace(text, r"[0-9.,/:%\s-]", "")) > 0
    parts = T.count_class(text, jamo)
    return df.where(
        (connector | (T.has_class(text, script) & worded))
        & ~((parts > T.count_class(text, complete) * 2) & (parts > 3))
        & (F.col("y0") >= 0)
        & (F.col("x0") >= 0)
        & (F.col("y1") <= F.col("page_height") + 10)
        & (F.col("x1") <= F.col("page_width") + 10)
        & (boxes.width() >= 5)
        & (boxes.height() >= 5)
    )


def filter_regions(df: DataFrame, min_conf: float = 0.2, min_area: float = 500.0, col: str = "text") -> DataFrame:
    """Drop doubtful and blank regions; small ones stay, untranslated."""
    return df.where((F.col("confidence") >= min_conf) & (T.strip(F.col(col)) != "")).withColumn(
        "too_small", boxes.area() < min_area
    )


def filter_script(df: DataFrame, col: str = "text", script: str = P.HANGUL) -> DataFrame:
    return df.where(T.has_class(F.col(col), script))


def script_share(df: DataFrame, *by: str, col: str = "text", script: str = P.HANGUL) -> DataFrame:
    """Share of the blocks of a page that hold the script."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.avg(T.has_class(F.col(col), script).cast("double")).alias("share"),
    )


def flag_vertical_regions(df: DataFrame, col: str = "text", script: str = P.HANGUL) -> DataFrame:
    """Tall narrow boxes of script text are translated but not drawn."""
    solid = T.without_space(F.col(col))
    n, size = T.count_class(solid, script), F.length(solid)
    return df.withColumn(
        "render_skip",
        (size >= 2)
        & (n > 0)
        & (n / F.greatest(size, F.lit(1)) >= 0.6)
        & (boxes.height() > boxes.width() * 2.5)
        & (boxes.width() < 80),
    )


def line_role(df: DataFrame) -> DataFrame:
    """Role of a text line; needs text, box, size, has_bullet and the page size."""
    y = F.when(F.col("page_height") > 0, F.col("y0") / F.col("page_height")).otherwise(0.0)
    centred = F.abs(boxes.center_x() - F.col("page_width") / 2) < F.col("page_width") * 0.15
    size, text = F.col("size"), F.col("text")
    bullet = F.col("has_bullet") | text.startswith("- ") | text.startswith("• ")
    return df.withColumn(
        "role",
        F.when(bullet, "bullet")
        .when((y < 0.15) & (size >= 20), "title")
        .when((size >= 16) & centred, "heading")
        .when((y > 0.85) & (size <= 10), "footer")
        .when(y > 0.85, "source")
        .when(size <= 10, "caption")
        .otherwise("body"),
    )


def block_role(df: DataFrame) -> DataFrame:
    """Role of a text block by average size, position and indent."""
    y = F.when(F.col("page_height") > 0, F.col("y0") / F.col("page_height")).otherwise(0.0)
    centred = F.abs(boxes.center_x() - F.col("page_width") / 2) < F.col("page_width") * 0.1
    size = F.col("size")
    return df.withColumn(
        "block_role",
        F.when((size >= 24) & (y < 0.2), "title")
        .when((size >= 18) & centred, "heading")
        .when(size <= 10, "caption")
        .when(F.col("x0") > F.col("page_width") * 0.1, "bullet")
        .otherwise("body"),
    )


def region_role(df: DataFrame) -> DataFrame:
    """Role of a recognised region by its height alone."""
    return df.withColumn(
        "region_role",
        F.when(boxes.height() > 40, "title")
        .when(boxes.height() > 25, "heading")
        .when(T.strip(F.col("text")).rlike("^[•\\-·▶►]"), "bullet")
        .otherwise("body"),
    )


def infer_roles(df: DataFrame) -> DataFrame:
    return region_role(block_role(line_role(df)))


def ends_sentence(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "").rlike(r"[\.!\?。？！]$")


def is_section(text: Column, words: str = P.SECTION_WORDS, principle: str = P.PRINCIPLE_TITLE) -> Column:
    after = T.strip(F.regexp_extract(text, rf"(?s)^.*?(?:{words})(.*)$", 1))
    return (text.rlike(words) & (F.length(after) >= 5) & ~text.rlike(principle)) | (
        text.endswith("?") & (F.length(text) < 50)
    )


def continues(text: Column, previous: Column, starts: list[str] = P.CONTINUATION_STARTS) -> Column:
    """The line goes on from the one before: lower-case or particle start, or a split phrase."""
    t = F.regexp_replace(text, r"^\s+", "")
    joined = F.regexp_replace(previous, r"\s+$", "").rlike(P.CONTINUATION_ENDINGS) & t.rlike(P.CONTINUATION_WORDS)
    return t.rlike(r"^\p{Ll}") | F.substring(t, 1, 1).isin(starts) | F.coalesce(joined, F.lit(False))


def is_diagram_label() -> Column:
    y = F.when(F.col("page_height") > 0, F.col("y0") / F.col("page_height")).otherwise(0.0)
    return (
        (F.length(T.strip(F.col("text"))) <= 20)
        & (F.col("size") <= 14)
        & F.col("role").isin("body", "caption")
        & (y >= 0.15)
        & (y <= 0.85)
    )


def tag_line_patterns(
    df: DataFrame, keys: list[str], order: list[str], principle: str = P.PRINCIPLE_TITLE,
    option: str = P.OPTION_PREFIX, section: str = P.SECTION_WORDS,
) -> DataFrame:
    """Pattern flags of lines in reading order; continuation looks at the line before."""
    text = T.strip(F.col("text"))
    df = with_scans(df, keys, order, {"previous_text": Lag(F.col("text"))})
    return df.withColumns(
        {
            "is_principle": text.rlike(principle),
            "is_option": text.rlike(option),
            "is_section": is_section(text, section, principle),
            "is_symbol": is_connector(F.col("text")),
            "ends_sentence": ends_sentence(F.col("text")),
            "is_continuation": continues(F.col("text"), F.col("previous_text")),
            "is_diagram": is_diagram_label(),
        }
    ).drop("previous_text")


def layout_defaults(df: DataFrame) -> DataFrame:
    """Layout guesses without a model: small short body text lies on an image; prefixes are kept."""
    on_image = (F.col("size") <= 12) & (F.col("role") == "body") & (F.length("text") < 20)
    return df.withColumns(
        {
            "on_image_background": on_image,
            "expand_allowed": ~on_image,
            "keep_prefix": F.coalesce(F.col("prefix") != "", F.lit(False)),
        }
    )


def search(df: DataFrame, cols: list[str], q: str, category: str | None = None) -> DataFrame:
    """Case-insensitive substring search over several columns, optionally in one category."""
    q = (q or "").strip().lower()
    if category:
        df = df.where(F.col("category") == category)
    return df.where(T.any_of([F.lower(F.col(c)).contains(q) for c in cols])) if q else df


def _in(names: list[str]):
    return lambda k, v: k.isin(names)


def project_events(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Per type, keep a whitelist of payload fields; the sender's clock only where present."""
    keep = None
    for kind, names in fields.items():
        picked = F.map_filter("payload", _in(names))
        keep = F.when(F.col("type") == kind, picked) if keep is None else keep.when(F.col("type") == kind, picked)
    stamped = F.when(
        F.col("sender_ts").isNotNull(),
        F.map_concat("payload", F.create_map(F.lit("sender_ts"), F.col("sender_ts").cast("string"))),
    ).otherwise(F.col("payload"))
    return df.where(F.col("type").isin(*fields)).withColumn("payload", keep).withColumn("payload", stamped)


def clean_chat(chat: DataFrame, participants: DataFrame, default_name: str = "professor") -> DataFrame:
    """Trimmed non-blank messages with the sender's name, or the default."""
    said = chat.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    names = participants.select(F.col("sender_id"), T.blank_to_null(F.col("name")).alias("_name"))
    return (
        said.join(names, "sender_id", "left")
        .withColumn("name", F.coalesce("_name", F.lit(default_name)))
        .drop("_name")
    )


def safe_filenames(
    df: DataFrame, col: str = "title", fallback: str = "stem", suffix: str | None = None, max_chars: int = 100
) -> DataFrame:
    """File name without forbidden characters, cut at 100; ``suffix`` is added when missing."""
    cleaned = T.safe_stem(F.coalesce(F.col(col), F.lit("")), P.FORBIDDEN_NAME_CHARS)
    name = F.when(cleaned == "", F.col(fallback)).otherwise(F.substring(cleaned, 1, max_chars))
    if suffix:
        name = F.when(F.lower(name).endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))
    return df.withColumn("filename", name)
