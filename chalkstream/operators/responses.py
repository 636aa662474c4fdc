"""Prompts for and answers of text models, around a model that is a plug-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as T
from ..functions.strict_json import is_json
from ..functions.generate import rows_of
from .aggregates import repeated_words
from .gates import gate_translations, kept_rows
from .joins import known_responses

TAGGED_RULES = [
    "Translate each text; keep it short enough for its box.",
    "Keep numbers as digits and keep symbols where they are.",
    "Add no bullet marks.",
    "Answer with one line per text: [BLOCK_ID]: translation",
]


def _ordered_lines(df: DataFrame, keys: list[str], pos: str, line: Column, name: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos), line.alias("_l"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["_l"]), "\n").alias(name))


def prompt_lines(doubtful: float = 0.8) -> Column:
    """``[id] (ROLE): text`` with a mark on recognised text of low confidence."""
    note = F.when(F.col("confidence") < doubtful, " [LOW_CONFIDENCE_OCR]").otherwise("")
    return F.concat(F.lit("["), "block_id", F.lit("] ("), F.upper("role"), note, F.lit("): "), "text")


def build_prompts(
    blocks: DataFrame, chunk: list[str], pos: str = "pos", terms: DataFrame | None = None,
    target: str = "EN", rules: list[str] = TAGGED_RULES, word_pattern: str = r"[가-힣]{2,}",
) -> DataFrame:
    """One prompt per chunk: rules, matched terms, repeated words, tagged lines. A chunk holds a
    bounded number of blocks (see ``windows.pack_chunks``); ``terms`` has the chunk keys, term, value."""
    body = _ordered_lines(blocks, chunk, pos, prompt_lines(), "body")
    keyed = blocks.withColumn("_chunk", F.struct(*chunk))
    words = repeated_words(keyed, "_chunk", pattern=word_pattern, pos=pos, limit=20)
    hint = words.groupBy("_chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda r: r["word"]), ", ").alias("words")
    ).select("_chunk.*", "words")
    out = body.join(hint, chunk, "left")
    if terms is not None:
        listed = terms.withColumn("_n", -F.length("term"))
        rows = F.sort_array(F.collect_list(F.struct("_n", "term", "value")))
        text = F.transform(rows, lambda r: F.concat(F.lit("  "), r["term"], F.lit(" = "), r["value"]))
        out = out.join(listed.groupBy(*chunk).agg(F.array_join(text, "\n").alias("terms")), chunk, "left")
    else:
        out = out.withColumn("terms", F.lit(None).cast("string"))
    parts = F.array_compact(
        F.array(
            F.lit(f"Translate the following texts to {target}."),
            F.when(F.col("terms").isNotNull(), F.concat(F.lit("Terms:\n"), "terms")),
            F.when(F.col("words").isNotNull(), F.concat(F.lit("Use one term for each of: "), "words")),
            F.lit("Rules:\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))),
            F.concat(F.lit("Texts:\n"), "body"),
        )
    )
    return out.withColumn("prompt", F.array_join(parts, "\n\n"))


def build_page_prompts(
    lines: DataFrame, page: list[str], pos: str = "pos", context: int = 20
) -> DataFrame:
    """Numbered form: one prompt per page with its first texts as context."""
    filled = lines.where(F.coalesce(F.col("text"), F.lit("")) != "")
    number = F.row_number().over(W.partitionBy(*page).orderBy(pos))
    rows = F.sort_array(F.collect_list(F.struct("n", "text")))
    per = filled.withColumn("n", number).groupBy(*page).agg(rows.alias("_r"))
    body = F.array_join(F.transform("_r", lambda r: F.concat(r["n"].cast("string"), F.lit(". "), r["text"])), "\n")
    ctx = F.array_join(F.transform(F.slice("_r", 1, context), lambda r: r["text"]), ", ")
    n = F.size("_r")
    return per.select(
        *page, n.cast("long").alias("total_lines"), ctx.alias("context"),
        F.concat(
            F.lit("Page: "), ctx, F.lit("\nTexts:\n"), body,
            F.lit("\nAnswer with "), n.cast("string"), F.lit(" lines of the form: number. translation"),
        ).alias("prompt"),
    )


def cleaned_answer(c: Column) -> Column:
    """Leaked id and role tags and added bullets removed."""
    c = F.regexp_replace(T.strip(c), r"^\[\w+\]\s*", "")
    c = F.regexp_replace(c, r"(?i)^\((?:TITLE|HEADING|BODY|BULLET|CAPTION|TERM_DEFINITION)\)\s*:?\s*", "")
    return T.strip(F.regexp_replace(T.strip(c), r"^[\-\*•■◆◇○●\s]+", ""))


def tagged_pairs(responses: DataFrame, col: str = "response") -> DataFrame:
    """(block_id, translated) pairs of an answer, by blocks; by lines where no block is found."""
    c = F.col(col)
    # A block runs to the next line that opens with a bracket; possessive, so long answers need no stack.
    pattern = F.lit(r"\[([^\]]+)\](?:\s*\([^)]+\))?:\s*([^\n]+(?:\n(?!\[)[^\n]*)*+)")
    ids, texts = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    blocks = F.arrays_zip(ids.alias("id"), texts.alias("text"))
    lines = F.filter(
        F.transform(F.split(T.strip(c), "\n"), lambda x: T.strip(x)), lambda x: x.rlike(r"^\[[^\]]+\][^:]*:\s*\S")
    )
    by_line = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("id"),
            T.strip(F.regexp_extract(x, r"^\[[^\]]+\][^:]*:(.*)$", 1)).alias("text"),
        ),
    )
    kind = "array<struct<id:string,text:string>>"
    pairs = F.when(F.size(ids) > 0, blocks.cast(kind)).otherwise(by_line.cast(kind))
    # Cleaned inside the array: cleaned after it, the planner copies the patterns into each rule of a gate further down.
    pairs = F.transform(pairs, lambda p: F.struct(T.strip(p["id"]).alias("id"), cleaned_answer(p["text"]).alias("text")))
    out = rows_of(responses, pairs, "pos", "_p")
    return out.withColumns({"block_id": F.col("_p.id"), "translated": F.col("_p.text")}).drop("_p")


def parse_tagged_responses(responses: DataFrame, requests: DataFrame, chunk: list[str], script: str = P.HANGUL) -> DataFrame:
    """Valid translations of requested blocks; of several answers to one block the last wins."""
    pairs = tagged_pairs(responses).select(*chunk, "pos", "block_id", "translated")
    valid = kept_rows(gate_translations(pairs, "translated", script))
    return known_responses(valid, requests, [*chunk, "block_id"])


def parse_numbered_responses(
    responses: DataFrame, key: str, total: str = "total_lines", col: str = "response", plain_order: bool = True
) -> DataFrame:
    """``n. text`` lines as rows with n in 1..N, the last of equal numbers. Plain lines are used by
    order only if no line in range is numbered and there are exactly N of them."""
    lines = F.filter(F.transform(F.split(F.col(col), "\n"), lambda x: T.strip(x)), lambda x: x != "")
    rows = rows_of(responses, lines, "pos", "line", [key, total])
    form = r"^(\d+)\s*[\.:\)\-]\s*(.+)$"
    unquote = lambda c: F.regexp_replace(T.strip(c), "^[\"']+|[\"']+$", "")
    num = F.regexp_extract("line", form, 1)
    rows = rows.withColumns(
        {
            "line_no": F.when(num != "", num.try_cast("long")),
            "translated": F.when(num != "", unquote(F.regexp_extract("line", form, 2))).otherwise(unquote(F.col("line"))),
        }
    )
    good = (
        rows.where(F.col("line_no").between(1, F.col(total)) & (F.col("translated") != ""))
        .groupBy(key, "line_no").agg(F.max_by("translated", "pos").alias("translated"))
    )
    if not plain_order:
        return good
    plain = rows.where(F.col("line_no").isNull())
    fitting = (
        plain.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(total).alias("_t")).where("_n = _t")
        .join(good.select(key), key, "left_anti")
    )
    number = F.row_number().over(W.partitionBy(key).orderBy("pos"))
    by_order = plain.join(fitting.select(key), key, "left_semi").select(key, number.cast("long").alias("line_no"), "translated")
    return good.unionByName(by_order)


def _balanced(c: Column) -> Column:
    """From the first opening brace to the brace that closes it; empty if none does."""
    start = F.instr(c, "{")
    rest = F.when(start > 0, F.substring(c, start, F.length(c))).otherwise("")

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        end = F.when((s["end"] == 0) & (ch == "}") & (depth == 0), s["pos"] + 1).otherwise(s["end"])
        return F.struct(
            depth.cast("int").alias("depth"), (s["pos"] + 1).cast("int").alias("pos"), end.cast("int").alias("end")
        )

    zero = F.struct(*[F.lit(0).cast("int").alias(n) for n in ("depth", "pos", "end")])
    end = F.aggregate(F.split(rest, ""), zero, step, lambda s: s["end"])
    return F.substring(rest, F.lit(1), end)


def extract_json_payload(df: DataFrame, col: str = "response") -> DataFrame:
    """JSON inside model text: an object with ``blocks``, a code fence, or the first balanced object.
    Adds ``payload`` (null if none parses) and ``payload_blocks``, the list of layout rows."""
    c = F.col(col)
    attempts = [
        F.regexp_extract(c, r'(\{\s*"blocks"\s*:\s*\[[\s\S]*?\]\s*\})', 1),
        T.strip(F.regexp_extract(c, r"```(?:json)?\s*([\s\S]*?)```", 1)),
        _balanced(c),
    ]
    valid = [F.when((a != "") & is_json(a), a) for a in attempts]
    out = df.withColumn("payload", F.coalesce(*valid))
    item = "struct<idx:long,on_image:boolean,expand_ok:boolean,merge_with:array<long>,keep_prefix:boolean>"
    as_list = F.from_json("payload", f"array<{item}>")
    as_object = F.from_json("payload", f"blocks array<{item}>")
    return out.withColumn(
        "payload_blocks",
        F.when(F.col("payload").startswith("["), as_list).otherwise(as_object["blocks"]),
    )


def layout_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per layout entry; of entries with one index the last counts."""
    rows = rows_of(df, F.col("payload_blocks"), "_pos", "_b", keys).where("_b.idx is not null")
    last = rows.groupBy(*keys, F.col("_b.idx").alias("idx")).agg(F.max_by("_b", "_pos").alias("_b"))
    return last.select(
        *keys, "idx",
        F.coalesce("_b.on_image", F.lit(False)).alias("on_image"),
        F.coalesce("_b.expand_ok", F.lit(True)).alias("expand_ok"),
        F.coalesce("_b.keep_prefix", F.lit(False)).alias("keep_prefix"),
        F.coalesce("_b.merge_with", F.array().cast("array<long>")).alias("merge_with"),
    )
