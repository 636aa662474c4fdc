"""Set operations and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as T
from .gates import filter_script
from .joins import page_rows


def union_blocks(layer: DataFrame, ocr: DataFrame, script: str = P.HANGUL) -> DataFrame:
    """Blocks of both sources, then the script filter."""
    return filter_script(layer.unionByName(ocr, allowMissingColumns=True), "text", script)


def union_pages(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def missing_ids(requests: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """1..n of each request minus the ids parsed, one row per missing id."""
    wanted = requests.where("total_lines > 0").select(
        key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("total_lines").cast("long"))).alias("line_no")
    )
    return wanted.join(parsed.select(key, "line_no"), [key, "line_no"], "left_anti")


def union_terms(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select("term").union(target.select("term")).where("term <> ''").distinct()


def glossary_insert(glossary: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows whose key is free; ids go on from the highest, blank categories become the default.
    Of several new rows with one key the first is taken."""
    from ..plans.scans import RowNumber, with_scans

    first = new.groupBy("term").agg(F.min_by(F.struct("value", "category", "pos"), F.col("pos")).alias("_r")).select("term", "_r.*")
    free = first.join(glossary.select("term"), "term", "left_anti")
    numbered = with_scans(free, [], ["pos"], {"_n": RowNumber()})
    top = glossary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    added = numbered.select(
        (F.lit(top) + F.col("_n")).alias("id"), "term", "value",
        F.coalesce(T.blank_to_null(F.col("category")), F.lit(P.DEFAULT_CATEGORY)).alias("category"),
    )
    return glossary.select("id", "term", "value", "category").unionByName(added)


def glossary_update(glossary: DataFrame, changes: DataFrame) -> DataFrame:
    """Rewrite the first row of a key; the category only where one is given. ``changes`` has term,
    new_term, new_value, new_category; of several changes of a key the last by ``pos`` counts, or the
    greatest where there is no such column. Adds ``updated``."""
    first = glossary.groupBy("term").agg(F.min("id").alias("id"))
    change = F.struct("new_term", "new_value", "new_category")
    last = F.max_by(change, "pos") if "pos" in changes.columns else F.max(change)
    one = changes.groupBy("term").agg(last.alias("_change")).select("term", "_change.*")
    hits = one.join(first, "term").select(
        "id", "new_term", "new_value", T.blank_to_null(F.col("new_category")).alias("_c")
    )
    joined = glossary.join(hits, "id", "left")
    return joined.select(
        "id", F.coalesce("new_term", "term").alias("term"), F.coalesce("new_value", "value").alias("value"),
        F.coalesce("_c", "category").alias("category"), F.col("new_term").isNotNull().alias("updated"),
    )


def missing_keys(changes: DataFrame, glossary: DataFrame) -> DataFrame:
    """Requested keys the glossary does not hold."""
    return changes.join(glossary.select("term"), "term", "left_anti")


def glossary_delete(glossary: DataFrame, keys: DataFrame) -> DataFrame:
    return glossary.join(keys.select("term"), "term", "left_anti")


def drop_category(glossary: DataFrame, name: str) -> DataFrame:
    c = F.col("category")
    return glossary.withColumn("category", F.when(c == name, P.DEFAULT_CATEGORY).otherwise(c))


def rename_items(library: DataFrame, renames: DataFrame, suffix: str = ".pdf", max_chars: int = 100) -> DataFrame:
    """New file names by id, cleaned, cut and with the suffix; blank names change nothing. The last
    rename of an id wins."""
    clean = F.substring(T.safe_stem(F.coalesce("new_name", F.lit("")), P.FORBIDDEN_NAME_CHARS), 1, max_chars)
    named = renames.withColumn("_n", T.blank_to_null(clean)).where(F.col("_n").isNotNull())
    full = F.when(F.lower("_n").endswith(suffix), F.col("_n")).otherwise(F.concat("_n", F.lit(suffix)))
    last = named.groupBy("slide_id").agg(F.max_by(full, F.col("pos")).alias("_name"))
    return (
        library.join(last, "slide_id", "left").withColumn("filename", F.coalesce("_name", "filename")).drop("_name")
    )


def set_last_page(library: DataFrame, views: DataFrame, order: list[str]) -> DataFrame:
    """Last page viewed; pages below 1 and unknown items change nothing."""
    last = views.where("page >= 1").groupBy("slide_id").agg(F.max_by("page", F.struct(*order)).alias("_p"))
    return library.join(last, "slide_id", "left").withColumn(
        "last_page", F.coalesce("_p", "last_page", F.lit(1)).cast("long")
    ).drop("_p")


def loadable_items(library: DataFrame, stored_pages: DataFrame, translated: DataFrame) -> DataFrame:
    """Page rows of completed items: the stored ones, rebuilt where an item has none."""
    done = library.where(F.col("status") == "completed")
    stored = stored_pages.join(done.select("slide_id"), "slide_id", "left_semi").select(
        "slide_id", "page_number", "has_translation"
    )
    bare = done.join(stored_pages.select("slide_id"), "slide_id", "left_anti")
    return stored.unionByName(page_rows(bare, translated))
