"""Benchmark leaks by template: numbers, names and units become typed placeholders, template windows meet in a
hash join, and the values behind the placeholders must correspond.

A question asked again with other numbers keeps its template, and each old value turns into one
new value everywhere; a chance match of placeholders does not. Windows of one document and item are grouped by
alignment (word position in the document less that in the item). Where an alignment turns one item value into
several, its changed words do not count. An item leaks into a document if consistent
alignments cover at least 13 of its words, or all of a shorter item. Columns and joins only.

Windows are taken in two forms. As templates, every capitalised word is a name and white space is all alike, so text before
an item, names at sentence starts and new line ends change nothing; item windows with more placeholders than
literal words say too little and are left out. As plain words in lower case every window is taken, so a verbatim
copy is found whatever it is made of and however it is capitalised. Items of fewer than five words are met
as plain word runs only.

Defined results: null and empty texts and items match nothing; a null ``doc_id`` is reported as such; rows with one
``doc_id`` are matched each on its own text and reported once per item; repeated items are reported per ``item_id``;
empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import params
from .lookups import counted
from .staging import stage

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
_GAP = r"[\x20\x09-\x0D]+"
_ENDS = " \t\n\x0b\x0c\r"
#: A capital inside a sentence: one space before it and no full stop before that.
_NAMES = r"(?<=[^.!?\x20\x09-\x0D] )\p{Lu}[\p{L}'’-]*"
#: Any capital and the letters behind it, wherever it stands.
_CAPITALS = r"\p{Lu}[\p{L}'’-]*"
NUMBERS = r"[$€£]?\d[\d.,:/]*"
UNITS = rf"{NUMBER}( ?)(?:{'|'.join(params.UNITS)})\b"
UNITS_APART = rf"{NUMBER}([\x20\x09-\x0D]*)(?:{'|'.join(params.UNITS)})\b"
DROPPED = rf"[^\p{{L}}\p{{N}}{NAME}-{UNIT}\x20\x09-\x0D]"


def _split(text: Column) -> Column:
    trimmed = F.btrim(F.regexp_replace(text, DROPPED, ""), F.lit(_ENDS))
    return F.when(trimmed != "", F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>"))


def template_words(text: Column) -> Column:
    """The words in lower case without punctuation, with placeholders for names, numbers and units."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _NAMES, NAME)
    marked = F.regexp_replace(F.regexp_replace(marked, NUMBERS, NUMBER), UNITS, f"{NUMBER}$1{UNIT}")
    return _split(F.lower(marked))


def open_words(text: Column) -> Column:
    """The same with every capitalised word as a name and any white space before a unit: a word's form does not
    depend on where a sentence, line or text begins."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _CAPITALS, NAME)
    marked = F.regexp_replace(F.regexp_replace(marked, NUMBERS, NUMBER), UNITS_APART, f"{NUMBER}$1{UNIT}")
    return _split(F.lower(marked))


def value_words(text: Column) -> Column:
    """The words at the same positions, with their own values."""
    return _split(F.lower(F.coalesce(text.cast("string"), F.lit(""))))


_HOLDS = f"[{NAME}-{UNIT}]"


def _item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    items = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].alias("_text"))
    words = items.select(
        "item_id", template_words(F.col("_text")).alias("_words"), open_words(F.col("_text")).alias("_open"),
        value_words(F.col("_text")).alias("_values"),
    )
    return stage(words.filter(F.size("_values") > 0), "items")


def _runs(words: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))


def _literals(window: Column) -> Column:
    """Words of a window that are no placeholders, with their lengths and places."""
    marked = F.transform(window, lambda w, k: F.when(~w.rlike(_HOLDS), F.struct(F.length(w).alias("l"), w.alias("w"), k.alias("k"))))
    return F.filter(marked, lambda x: x.isNotNull())


def _item_windows(items: DataFrame) -> DataFrame:
    """Windows of items in both forms: their hash, and the place in the window of the anchor, its longest literal word."""
    parts = []
    for form, by in (("open", "_open"), ("plain", "_values")):
        n = F.least(F.size(by), F.lit(params.TEMPLATE_WINDOW))
        windows = items.select(
            "item_id", F.size(by).alias("item_words"), n.alias("size"),
            F.posexplode(_runs(F.col(by), n)).alias("item_pos", "_w"),
        )
        windows = windows.withColumn("_l", _literals(F.col("_w")))
        if form == "open":
            windows = windows.filter((F.size("_l") >= params.MIN_LITERALS * F.col("size")) & (F.col("item_words") >= params.MIN_ITEM_WORDS))
        anchor = F.array_max("_l")
        parts.append(windows.select(
            "item_id", "item_pos", "size", F.lit(form).alias("form"), F.xxhash64("_w").alias("hash"),
            F.xxhash64(anchor["w"]).alias("anchor"), anchor["k"].alias("anchor_at"),
        ))
    return stage(parts[0].union(parts[1]), "item-windows")


def _covered(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Words of items met by windows of documents: key, alignment, item position and the document's word, each once.

    A document is cut into words once, in both forms. Its words meet the anchors; only where one stands the window
    around it is hashed and looked up."""
    wanted = _item_windows(items)
    anchors = counted(wanted.select("anchor", "anchor_at", "size", "form").distinct())
    words = docs.select("doc_id", "mark", open_words(F.col("_text")).alias("_open"), value_words(F.col("_text")).alias("_values"))
    # The outer form: for the other one Spark adds a filter on the array, which would build it, and the words, again.
    each = words.select("doc_id", "mark", "_open", "_values", F.posexplode_outer("_values").alias("pos", "_w"))
    found = each.withColumn("anchor", F.xxhash64("_w")).join(anchors, "anchor").withColumn("begin", F.col("pos") - F.col("anchor_at"))
    found = found.filter((F.col("begin") >= 0) & (F.col("begin") + F.col("size") <= F.size("_values")))
    at = F.greatest(F.col("begin"), F.lit(0)) + 1  # the filter may run after the slice
    own = F.when(F.col("form") == "open", F.slice("_open", at, F.col("size"))).otherwise(
        F.slice("_values", at, F.col("size"))
    )
    found = found.select("doc_id", "mark", "begin", "size", "form", "_values", F.xxhash64(own).alias("hash"))
    met = found.join(counted(wanted.drop("anchor", "anchor_at")), ["hash", "size", "form"]).select(
        "doc_id", "mark", "item_id", (F.col("begin") - F.col("item_pos")).alias("shift"), "item_pos",
        F.slice("_values", at, F.col("size")).alias("_d"),
    )
    spans = met.select("doc_id", "mark", "item_id", "shift", F.col("item_pos").alias("_p"), F.posexplode("_d").alias("_k", "doc_value"))
    by = ["doc_id", "mark", "item_id", "shift", (F.col("_p") + F.col("_k")).alias("item_pos")]
    return stage(spans.groupBy(*by).agg(F.min("doc_value").alias("doc_value")), "covered")


def _with_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("mark"), docs[text].alias("_text"))


def _leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks of rows with ``doc_id``, ``mark`` (a hash of the text) and ``_text``."""
    covered = _covered(docs, items)
    item_word = items.select(
        "item_id", F.size("_values").alias("item_words"),
        F.posexplode(F.arrays_zip("_words", "_open", "_values")).alias("item_pos", "_w"),
    ).select(
        "item_id", "item_words", "item_pos", F.col("_w._values").alias("item_value"),
        F.col("_w._words").rlike(_HOLDS).alias("slot"), F.col("_w._open").rlike(_HOLDS).alias("open_slot"),
    )
    words = stage(covered.join(counted(item_word), ["item_id", "item_pos"]), "covered-words")
    at = ["doc_id", "mark", "item_id", "shift"]
    # Values of an item that one alignment turns into several: where they are changed, the words do not count.
    torn = words.filter("open_slot").groupBy(*at, "item_value").agg(
        F.min("doc_value").alias("lo"), F.max("doc_value").alias("hi")
    ).filter("lo <> hi").select(*[F.col(c).alias(f"_{c}") for c in (*at, "item_value")])
    same = reduce(lambda x, y: x & y, [words[c].eqNullSafe(torn[f"_{c}"]) for c in (*at, "item_value")])
    changed = F.col("doc_value") != F.col("item_value")
    good = words.join(torn, same & words["open_slot"] & changed, "left_anti")
    # Per alignment first, so that a document or item with many is summed up where it is read.
    per = good.groupBy(*at).agg(
        F.max("item_words").cast("long").alias("item_words"), F.collect_set("item_pos").alias("places"),
        F.count_if("slot").alias("n_slots"), F.count_if(F.col("slot") & changed).alias("n_changed"),
    )
    return per.groupBy("doc_id", "mark", "item_id").agg(
        F.max("item_words").alias("item_words"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("covered_words"),
        F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"),
    ).filter(F.col("covered_words") >= F.least(F.lit(params.LEAK_WORDS), F.col("item_words")))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that leaks into it: how many of its words are covered, how many values of
    numbers, names and units were compared on the fullest alignment and how many of them differ."""
    found = _leaks(_with_key(docs, doc_id, text), _item_words(benchmark, item_id, item_text))
    return found.groupBy("doc_id", "item_id").agg(
        *[F.max(c).alias(c) for c in ("item_words", "covered_words", "n_slots", "n_changed")]
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no item leaks into, with the columns they came with."""
    found = _leaks(_with_key(docs, doc_id, text), _item_words(benchmark, item_id, item_text))
    gone = stage(found.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).distinct(), "leaking")
    given = [f"_in{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, given, strict=True))
    rows = docs.toDF(*given)
    same = rows[at[doc_id]].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(rows[at[text]]) == F.col("_m"))
    left = rows.join(counted(gone), same, "left_anti")
    return left.select(*[F.col(g).alias(c) for c, g in zip(docs.columns, given, strict=True)])
