"""Lookups, reconciliation, as-of and range joins.

Spark picks broadcast or shuffled joins from sizes it measures at run time. As-of and interval
lookups are a union of both sides and a scan along time, never a range join, so they cost one sort
and survive hot keys (see ``plans.scans``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions import text as T
from ..plans.scans import Lag, LastSeen, RowNumber, RunMax, RunSum, with_scans
from ..plans.sizes import group_sizes
from ..session import cut_lineage


def last_translations(translations: DataFrame) -> DataFrame:
    """One translation per block: the last by ``pos`` where there is such a column, the greatest otherwise."""
    last = F.max_by("translated", "pos") if "pos" in translations.columns else F.max("translated")
    return translations.groupBy("block_id").agg(last.alias("translated"))


def attach_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Translation per block, or the source text where there is none."""
    t = last_translations(translations).select("block_id", T.blank_to_null(F.col("translated")).alias("_t"))
    joined = blocks.join(t, "block_id", "left")
    return joined.withColumn("translated", F.coalesce("_t", "text")).drop("_t")


def missing_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Blocks without a non-blank translation."""
    return blocks.join(translations.where(T.strip(F.col("translated")) != ""), "block_id", "left_anti")


def known_responses(responses: DataFrame, requests: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Responses whose id was requested; of duplicates the last one wins. Requests grow with the responses and are
    often exploded from few rows, whose size Spark takes for theirs, so they are never broadcast."""
    value_cols = [c for c in responses.columns if c not in (*keys, pos)]
    last = responses.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), F.col(pos)).alias("_v"))
    return last.join(requests.select(*keys).hint("merge"), keys, "left_semi").select(*keys, "_v.*")


def attach_layout(blocks: DataFrame, layout: DataFrame, page_keys: list[str]) -> DataFrame:
    """Layout row by the index inside the block id, else by list position, else defaults.

    ``layout`` has the page keys, ``idx`` and the flags; ``blocks`` has ``block_id`` and ``pos``.
    """
    flags = {"on_image": False, "expand_ok": True, "keep_prefix": False}
    inner = F.regexp_extract("block_id", r"b(\d+)", 1)
    keyed = blocks.withColumn("_idx", F.when(inner != "", inner.cast("long")).otherwise(F.col("pos")))

    def side(tag: str, key: str) -> DataFrame:
        cols = [F.col(f).alias(f"{tag}{f}") for f in flags]
        return layout.select(*page_keys, F.col("idx").alias(key), F.lit(True).alias(f"{tag}hit"), *cols)

    joined = keyed.join(side("_a", "_idx"), [*page_keys, "_idx"], "left").join(
        side("_b", "pos"), [*page_keys, "pos"], "left"
    )
    picked = {
        f: F.coalesce(F.when(F.col("_ahit"), F.col(f"_a{f}")).when(F.col("_bhit"), F.col(f"_b{f}")), F.lit(d))
        for f, d in flags.items()
    }
    return joined.withColumns(picked).select(*blocks.columns, *flags)


def dedup_against_library(uploads: DataFrame, library: DataFrame, content: Column) -> DataFrame:
    """Reuse the id of a completed item with the same content. Uploads of one batch are not compared
    with each other, since a hash counts only once its item is complete."""
    done = (
        library.where((F.col("status") == "completed") & F.col("file_exists"))
        .groupBy("content_hash")
        .agg(F.max_by("slide_id", "uploaded_at").alias("existing_id"))
    )
    hashed = uploads.withColumn("content_hash", F.sha2(content, 256))
    return hashed.join(done, "content_hash", "left").withColumn("deduplicated", F.col("existing_id").isNotNull())


def pending_pages(pages: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Pages without a cached stage result."""
    return pages.join(cache.select(*keys), keys, "left_anti")


def migrate_orphans(files: DataFrame, meta: DataFrame, page_images: DataFrame) -> DataFrame:
    """Files without metadata and with at least one page image get a metadata row."""
    counts = page_images.groupBy("slide_id").agg(F.count(F.lit(1)).alias("total_pages"))
    return (
        files.join(meta.select("slide_id"), "slide_id", "left_anti")
        .join(counts, "slide_id")
        .withColumn("filename", F.concat(F.col("slide_id").cast("string"), F.lit(".pdf")))
        .withColumn("status", F.lit("completed"))
    )


def page_rows(items: DataFrame, translated: DataFrame) -> DataFrame:
    """Rows of a page list rebuilt from the page count, with a translated flag."""
    pages = items.where("total_pages > 0").select(
        "slide_id", F.explode(F.sequence(F.lit(0), F.col("total_pages").cast("int") - 1)).alias("page_number")
    )
    marks = translated.select("slide_id", "page_number").distinct().withColumn("has_translation", F.lit(True))
    return pages.join(marks, ["slide_id", "page_number"], "left").withColumn(
        "has_translation", F.coalesce("has_translation", F.lit(False))
    )


def repair_page_data(library: DataFrame, translated: DataFrame) -> DataFrame:
    """Page rows of items whose page list is empty although they have pages."""
    empty = library.where(F.coalesce(F.col("page_rows"), F.lit(0)) == 0)
    return page_rows(empty, translated)


def asof_page(
    utterances: DataFrame, page_changes: DataFrame, key: str = "session_id", ts: str = "ts_ms", tie: str = "event_id"
) -> DataFrame:
    """Page and slide in force when an utterance began. A slide choice resets the page to 1.

    ``page_changes`` has ``slide_id`` (on a slide choice) or ``page``. At equal times the change
    counts first.
    """
    state = F.struct(
        F.coalesce(F.col("page"), F.when(F.col("slide_id").isNotNull(), F.lit(1))).cast("long").alias("page")
    )
    changes = page_changes.select(
        key, ts, tie, F.lit(0).alias("_side"), state.alias("_p"), F.col("slide_id").alias("_s"),
        *[F.lit(None).cast(utterances.schema[c].dataType).alias(c) for c in utterances.columns if c not in (key, ts, tie)],
    )
    said = utterances.select(
        key, ts, tie, F.lit(1).alias("_side"),
        F.lit(None).cast(changes.schema["_p"].dataType).alias("_p"),
        F.lit(None).cast(changes.schema["_s"].dataType).alias("_s"),
        *[c for c in utterances.columns if c not in (key, ts, tie)],
    )
    both = changes.unionByName(said)
    seen = with_scans(
        both, [key], [ts, "_side", tie], {"_page": LastSeen(F.col("_p")), "slide_in_force": LastSeen(F.col("_s"))}
    )
    return (
        seen.where("_side = 1")
        .withColumn("page_in_force", F.coalesce(F.col("_page.page"), F.lit(1).cast("long")))
        .select(*utterances.columns, "page_in_force", "slide_in_force")
    )


def guard_cursor(cursors: DataFrame, page_changes: DataFrame, key: str = "session_id", ts: str = "ts_ms") -> DataFrame:
    """Hide a cursor whose page is not the one the viewer sees."""
    seen = asof_page(cursors, page_changes, key, ts)
    same = F.col("cursor_page").isNull() | (F.col("cursor_page") == F.col("page_in_force"))
    return seen.withColumn("visible", F.col("visible") & same)


def within_active(
    rows: DataFrame, lifecycle: DataFrame, key: str = "session_id", ts: str = "ts_ms", tie: str = "event_id"
) -> DataFrame:
    """Rows inside [start, end) and outside [pause, resume). ``lifecycle.type`` is start, end, pause
    or resume. At equal times the lifecycle event counts first."""
    running = F.when(F.col("type") == "start", True).when(F.col("type") == "end", False)
    paused = F.when(F.col("type") == "pause", True).when(F.col("type").isin("start", "resume", "end"), False)
    rest = [c for c in rows.columns if c not in (key, ts, tie)]
    marks = lifecycle.select(
        key, ts, tie, F.lit(0).alias("_side"), running.alias("_run"), paused.alias("_pause"),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest],
    )
    body = rows.select(
        key, ts, tie, F.lit(1).alias("_side"), F.lit(None).cast("boolean").alias("_run"),
        F.lit(None).cast("boolean").alias("_pause"), *rest,
    )
    seen = with_scans(
        marks.unionByName(body), [key], [ts, "_side", tie],
        {"_r": LastSeen(F.col("_run")), "_p": LastSeen(F.col("_pause"))},
    )
    active = F.coalesce("_r", F.lit(False)) & ~F.coalesce("_p", F.lit(False))
    return seen.where((F.col("_side") == 1) & active).select(*rows.columns)


def trim_words(words: DataFrame, segments: DataFrame, key: str = "utt_id", pos: str = "pos") -> DataFrame:
    """Words kept while the characters before them are fewer than the trimmed text has."""
    size = F.length(F.replace(F.coalesce("word", F.lit("")), F.lit(" "), F.lit("")))
    run = with_scans(words, [key], [pos], {"_before": RunSum(size, inclusive=False)})
    target = segments.select(key, F.length(F.replace("trimmed", F.lit(" "), F.lit(""))).alias("_target"))
    return run.join(target, key).where(F.col("_before") < F.col("_target")).select(*words.columns)


def align_words(
    words: DataFrame, sentences: DataFrame, chunks: DataFrame, key: str = "utt_id", pos: str = "pos"
) -> DataFrame:
    """Start of the first and end of the last word under each sentence, by non-space characters.

    Words and sentences are laid on one character axis. A sentence starts in the last word that
    begins at or before its first character; both ends are as-of lookups on that axis. Sentences
    with nothing under them get the chunk's bounds.
    """
    def solid(c: str) -> Column:
        return F.length(F.translate(F.coalesce(F.col(c), F.lit("")), " \n", ""))

    w = with_scans(
        words.withColumn("_n", solid("word")).where("_n > 0"), [key], [pos],
        {"_from": RunSum(F.col("_n"), inclusive=False)},
    )
    s = with_scans(
        sentences.withColumn("_n", solid("sentence")), [key], [pos],
        {"_from": RunSum(F.col("_n"), inclusive=False)},
    )
    total = w.groupBy(key).agg(F.max(F.col("_from") + F.col("_n")).alias("_total"))
    s = s.join(total, key, "left")
    inside = (F.col("_n") > 0) & (F.col("_from") < F.col("_total"))
    last = F.least(F.col("_from") + F.col("_n"), F.col("_total")) - 1
    ends = s.where(inside).select(
        key, pos, F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("_from").alias("at")),
                                    F.struct(F.lit("b").alias("end"), last.alias("at")))).alias("_e")
    )
    span = F.struct(F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    axis = w.select(
        key, F.col("_from").alias("_at"), F.lit(0).alias("_side"), F.lit(-1).cast("long").alias(pos),
        F.lit("").alias("_end"), span.alias("_w"),
    ).unionByName(
        ends.select(
            key, F.col("_e.at").alias("_at"), F.lit(1).alias("_side"), F.col(pos).cast("long").alias(pos),
            F.col("_e.end").alias("_end"),
            F.lit(None).cast("struct<start:double,stop:double>").alias("_w"),
        )
    )
    seen = with_scans(axis, [key], ["_at", "_side", pos, "_end"], {"_under": LastSeen(F.col("_w"))}).where("_side = 1")
    found = seen.groupBy(key, pos).agg(
        F.max(F.when(F.col("_end") == "a", F.col("_under.start"))).alias("_start"),
        F.max(F.when(F.col("_end") == "b", F.col("_under.stop"))).alias("_stop"),
    )
    c = chunks.select(key, F.col("speech_start_ms"), F.col("duration_ms"))
    out = s.select(key, pos, "sentence").join(found, [key, pos], "left").join(c, key)
    base = F.col("speech_start_ms")
    ms = lambda x: (F.col(x) * 1000).cast("long")
    return out.select(
        key, pos, "sentence",
        F.when(F.col("_start").isNotNull(), base + ms("_start")).otherwise(base).alias("start_ms"),
        F.when(F.col("_start").isNotNull(), base + ms("_stop")).otherwise(base + F.col("duration_ms")).alias("stop_ms"),
    )


def _near_cells(df: DataFrame, a: Column, b: Column, la: Column, lb: Column) -> DataFrame:
    """Cells twice as wide as the limits: what lies within a limit is in the own cell or the one on the
    nearer side, four cells in all."""

    def two(c: Column, limit: Column) -> Column:
        cell = F.floor(c / (limit * 2))
        side = F.when(c / (limit * 2) - cell < 0.5, -1).otherwise(1)
        return F.array(cell, cell + side)

    return df.withColumn("_px", F.explode(two(a, la))).withColumn("_py", F.explode(two(b, lb)))


def _joined(c: str) -> Column:
    return F.col(f"{c}_o")


def _differs(other=_joined) -> Column:
    return T.any_of([F.col(c) != other(c) for c in boxes.BOX])


def _distance_to(ox: Column, oy: Column) -> Column:
    return F.sqrt(F.pow(boxes.center_x() - ox, 2) + F.pow(boxes.center_y() - oy, 2))


def _is_near(distance: float, other=_joined) -> Column:
    return _distance_to((other("x0") + other("x1")) / 2, (other("y0") + other("y1")) / 2) < distance


def _alignments(t: float) -> list[tuple]:
    """Tests as (own edge a, other's edge a, limit a, own edge b, other's edge b, limit b)."""
    return [
        (y, y, t, own, other, t * 2) for y in ("y0", "y1") for own, other in (("x1", "x0"), ("x0", "x1"))
    ] + [("x0", "x0", t, own, other, t * 3) for own, other in (("y1", "y0"), ("y0", "y1"))]


def _is_aligned(t: float, other=_joined) -> Column:
    return T.any_of(
        [(F.abs(F.col(a) - other(oa)) < la) & (F.abs(F.col(b) - other(ob)) < lb) for a, oa, la, b, ob, lb in _alignments(t)]
    )


PAGE_PAIRS = 64  # pages with at most this many distinct boxes are compared box by box


def _with_neighbours(every: DataFrame, asked: DataFrame, page: list[str], test: Column, grid) -> DataFrame:
    """Boxes of ``asked`` for which another box of the page passes ``test``. On pages of ordinary size a
    box meets at most ``PAGE_PAIRS`` others; larger pages go through ``grid(every, asked)``."""
    here = [*page, *boxes.BOX]
    size = every.groupBy(*page).agg(F.count(F.lit(1)).alias("_n"))
    small, large = size.where(F.col("_n").between(2, PAGE_PAIRS)), size.where(F.col("_n") > PAGE_PAIRS)
    others = every.join(small.select(*page), page, "left_semi").select(*page, *[F.col(c).alias(f"{c}_o") for c in boxes.BOX])
    direct = asked.join(others, page).where(_differs() & test).select(*here)
    crowded = grid(every.join(large.select(*page), page, "left_semi"), asked.join(large.select(*page), page, "left_semi"))
    return direct.unionByName(crowded).distinct()


def near_boxes(df: DataFrame, page: list[str], distance: float, asked: DataFrame | None = None) -> DataFrame:
    """Distinct boxes (of ``asked``, else all) that have another, different box with its centre nearer
    than ``distance``. Equal boxes never count, so copies are met once.

    In a cell with a diagonal below the distance two boxes are near for sure: a count settles them.
    Only boxes alone in such a cell meet others, and few of those fit into the reach of one box.
    """
    every = _distinct_boxes(df, page)
    return _near(every, every if asked is None else _distinct_boxes(asked, page), page, distance)


def _distinct_boxes(df: DataFrame, page: list[str]) -> DataFrame:
    """Distinct boxes, written once: the steps below read them several times."""
    return cut_lineage(df.select(*page, *boxes.BOX).distinct())


def _near(every: DataFrame, asked: DataFrame, page: list[str], distance: float) -> DataFrame:
    here = [*page, *boxes.BOX]
    fine = distance / 1.5
    center = {"_cx": boxes.center_x(), "_cy": boxes.center_y()}

    def placed(d: DataFrame) -> DataFrame:
        return d.withColumns(center).withColumns(
            {"_fx": F.floor(F.col("_cx") / fine), "_fy": F.floor(F.col("_cy") / fine)}
        )

    def grid(every: DataFrame, asked: DataFrame) -> DataFrame:
        all_boxes = placed(every)
        crowd = all_boxes.groupBy(*page, "_fx", "_fy").agg(F.count(F.lit(1)).alias("_crowd"))
        marked = placed(asked).join(crowd, [*page, "_fx", "_fy"])
        settled = marked.where("_crowd > 1").select(*here)
        single = _near_cells(marked.where("_crowd = 1"), F.col("_cx"), F.col("_cy"), F.lit(distance), F.lit(distance))
        others = all_boxes.select(
            *page, F.floor(F.col("_cx") / (2 * distance)).alias("_px"), F.floor(F.col("_cy") / (2 * distance)).alias("_py"),
            *[F.col(c).alias(f"{c}_o") for c in (*boxes.BOX, "_cx", "_cy")],
        )
        close = _distance_to(F.col("_cx_o"), F.col("_cy_o")) < distance
        return settled.unionByName(single.join(others, [*page, "_px", "_py"]).where(_differs() & close).select(*here))

    return _with_neighbours(every, asked, page, _is_near(distance), grid)


def _alone(df: DataFrame, page: list[str], name: str, asked: Column, test, crowded, most: int | None) -> DataFrame:
    """Adds ``name``: true for rows of ``asked`` without a different box on their page that passes ``test``.

    On pages of at most ``PAGE_PAIRS`` rows, the boxes of the page stand beside each row as one array; rows that come by page
    move nowhere. Rows of larger pages are written once and go through ``crowded``, which gives their boxes that stand
    alone. ``most`` is the number of rows on the largest page, if the caller has counted them.
    """
    if most is None:
        most = group_sizes(df, page)[0]
    here = [*page, *boxes.BOX]
    large = None
    if most > PAGE_PAIRS:
        df = cut_lineage(df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*page))))
        large, df = df.where(F.col("_n") > PAGE_PAIRS).drop("_n"), df.where(F.col("_n") <= PAGE_PAIRS).drop("_n")
    on_page = F.collect_list(F.struct(*boxes.BOX)).over(W.partitionBy(*page))
    met = F.exists("_boxes", lambda o: _differs(o.getField) & test(o.getField))
    # A page without a name is no page: its boxes have no neighbours.
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in page])
    alone = F.when(asked, ~F.coalesce(known & met, F.lit(False))).otherwise(F.lit(False))
    out = df.withColumn("_boxes", on_page).withColumn(name, alone).drop("_boxes")
    if large is None:
        return out
    found = crowded(_distinct_boxes(large, page), _distinct_boxes(large.where(asked), page)).withColumn(name, F.lit(True))
    rest = large.join(found, here, "left").withColumn(name, F.coalesce(asked & F.col(name), F.lit(False)))
    return out.unionByName(rest.select(*out.columns))


def isolated_regions(
    df: DataFrame, page: list[str], distance: float = 50.0, max_area: float = 3000.0, max_chars: int = 5,
    most: int | None = None,
) -> DataFrame:
    """Isolated, small and short regions are literal labels; the rest is read in context."""
    here = [*page, *boxes.BOX]
    out = _alone(
        df, page, "isolated", F.lit(True), lambda o: _is_near(distance, o),
        lambda every, asked: asked.join(_near(every, asked, page, distance), here, "left_anti"), most,
    )
    chars = F.length(T.without_space(F.coalesce(F.col("text"), F.lit(""))))
    literal = F.col("isolated") & (boxes.area() < max_area) & (chars < max_chars)
    return out.withColumn("text_class", F.when(literal, "STRICT_LITERAL").otherwise("CONTEXT_AWARE"))


def aligned_boxes(df: DataFrame, page: list[str], t: float, asked: DataFrame | None = None) -> DataFrame:
    """Distinct boxes (of ``asked``, else all) aligned with another, different box of the page.

    Each of six tests bounds two differences between an edge of one box and an edge of the other. A box
    is one row per test, and all tests are one equality join on the test and a two-dimensional grid.
    """
    every = _distinct_boxes(df, page)
    return _aligned(every, every if asked is None else _distinct_boxes(asked, page), page, t)


def _aligned(every: DataFrame, asked: DataFrame, page: list[str], t: float) -> DataFrame:
    here = [*page, *boxes.BOX]
    tests = _alignments(t)

    def rows(d: DataFrame, mine: bool) -> DataFrame:
        per_test = [
            F.struct(
                F.lit(i).alias("test"), F.col(a if mine else oa).alias("a"), F.col(b if mine else ob).alias("b"),
                F.lit(float(la)).alias("la"), F.lit(float(lb)).alias("lb"),
            )
            for i, (a, oa, la, b, ob, lb) in enumerate(tests)
        ]
        out = d.withColumn("_t", F.explode(F.array(*per_test))).select(*here, "_t.*")
        return out.withColumns({"_fx": F.floor(F.col("a") / F.col("la")), "_fy": F.floor(F.col("b") / F.col("lb"))})

    def grid(every: DataFrame, asked: DataFrame) -> DataFrame:
        return _aligned_on_grid(rows(every, False), rows(asked, True), page)

    return _with_neighbours(every, asked, page, _is_aligned(t), grid)


def _aligned_on_grid(other: DataFrame, mine: DataFrame, page: list[str]) -> DataFrame:
    here = [*page, *boxes.BOX]
    # Inside one cell as wide as the limits any two edges are close: two boxes of the other side in the
    # own cell settle a test by a count. Only the rows still open meet others one by one.
    cell = [*page, "test", "_fx", "_fy"]
    crowd = other.groupBy(*cell).agg(F.count(F.lit(1)).alias("_crowd")).where("_crowd > 1")
    counted = mine.join(crowd, cell, "left")
    settled = counted.where("_crowd is not null").select(*here)
    single = _near_cells(counted.where("_crowd is null"), F.col("a"), F.col("b"), F.col("la"), F.col("lb"))
    others = other.select(
        *page, "test", F.floor(F.col("a") / (F.col("la") * 2)).alias("_px"), F.floor(F.col("b") / (F.col("lb") * 2)).alias("_py"),
        F.col("a").alias("_oa"), F.col("b").alias("_ob"), *[F.col(c).alias(f"{c}_o") for c in boxes.BOX],
    )
    close = (F.abs(F.col("a") - F.col("_oa")) < F.col("la")) & (F.abs(F.col("b") - F.col("_ob")) < F.col("lb"))
    met = single.join(others, [*page, "test", "_px", "_py"]).where(_differs() & close).select(*here)
    return settled.unionByName(met)


def classify_constraint(
    df: DataFrame, page: list[str], nearby: float = 80.0, alignment: float = 25.0,
    area_ratio: float = 0.015, max_label: int = 15, aspect: float = 3.0, aspect_per_char: float = 0.5, most: int | None = None,
) -> DataFrame:
    """The richer label rule: isolation, alignment, area share, aspect by length, punctuation.

    What a row can tell by itself comes first; only the rows left ask for neighbours, and on crowded pages only
    those without neighbours ask for alignment.
    """
    here = [*page, *boxes.BOX]
    image = F.col("page_width") * F.col("page_height")
    share = F.when(image > 0, boxes.area() / image).otherwise(0.0)
    shape = F.when(boxes.height() > 0, boxes.width() / boxes.height()).otherwise(1.0)
    size = F.length("text")
    label = (
        (share < area_ratio)
        & (shape < size * aspect_per_char + aspect)
        & (size < max_label)
        & ~F.col("text").rlike(r"[\.,;:!\?]")
        & ~F.col("text").rlike("^[\\-•·ㆍ●]")
    )

    def crowded(every: DataFrame, labels: DataFrame) -> DataFrame:
        alone = cut_lineage(labels.join(_near(every, labels, page, nearby), here, "left_anti"))
        return alone.join(_aligned(every, alone, page, alignment), here, "left_anti")

    marked = df.withColumn("_label", F.coalesce(label, F.lit(False)))
    out = _alone(
        marked, page, "_literal", F.col("_label"), lambda o: _is_near(nearby, o) | _is_aligned(alignment, o), crowded, most
    )
    return out.withColumn("constraint", F.when(F.col("_literal"), "STRICT_LITERAL").otherwise("CONTEXT_AWARE")).drop("_label", "_literal")


def attach_bullets(
    lines: DataFrame, bullets: DataFrame, page: list[str], pos: str = "pos", reach: float = 0.8, most: int | None = None
) -> DataFrame:
    """A bullet-only line met earlier on the page, left of the line and within 0.8 line heights,
    makes the line a bullet.

    The bullets of a page of ordinary size go to its lines as one array. Pages of more bullets take strips (see
    ``_bullets_by_strip``). ``most`` is the largest number of bullets on a page, if the caller has counted them.
    """
    if most is None:
        most = group_sizes(bullets, page)[0]
    few, crowded = bullets, None
    if most > PAGE_PAIRS:
        lines, bullets = cut_lineage(lines), cut_lineage(bullets)
        crowds = bullets.groupBy(*page).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PAGE_PAIRS).select(*page)
        few = bullets.join(crowds, page, "left_anti")
        crowded = _bullets_by_strip(
            lines.join(crowds, page, "left_semi"), bullets.join(crowds, page, "left_semi"), page, pos, reach
        )
    mark = F.struct(F.col(pos).alias("pos"), F.col("x0").alias("x0"), boxes.center_y().alias("mid"))
    marks = few.groupBy(*page).agg(F.collect_list(mark).alias("_marks"))
    met = F.exists(
        "_marks",
        lambda b: (b["pos"] < F.col(pos)) & (b["x0"] < F.col("x0"))
        & (F.abs(boxes.center_y() - b["mid"]) < boxes.height() * reach),
    )
    # Bullets are no fewer than their pages, so this side is never broadcast: both come by page.
    out = lines.join(marks.hint("merge"), page, "left").withColumn("_bullet", F.coalesce(met, F.lit(False))).drop("_marks")
    if crowded is not None:
        hit = crowded.withColumn("_hit", F.lit(True))
        out = out.join(hit, [*page, pos], "left").withColumn("_bullet", F.coalesce("_hit", "_bullet")).drop("_hit")
    return out.withColumn("has_bullet", F.col("has_bullet") | F.col("_bullet")).select(*lines.columns)


def _bullets_by_strip(lines: DataFrame, bullets: DataFrame, page: list[str], pos: str, reach: float) -> DataFrame:
    """Page and place of the lines that a bullet makes a bullet, for pages of any size.

    Line heights differ, so lines are grouped by the power of two above their reach. In a strip of half
    that height every bullet is near enough: a running minimum of bullet places along the page settles
    its lines. Only lines still open meet the bullets of the strips around them.
    """
    mid = boxes.center_y()
    band = F.ceil(F.log2(F.greatest(boxes.height() * reach, F.lit(1e-3)))).cast("int")
    strip = F.pow(F.lit(2.0), F.col("_band") - 1)
    left = lines.select(*page, pos, "x0", mid.alias("_mid"), (boxes.height() * reach).alias("_reach"), band.alias("_band"))
    # Bands are few: the number of powers of two between the lowest and the highest line.
    bands = [r[0] for r in left.select("_band").distinct().collect()]
    marks = bullets.select(
        *page, F.col(pos), F.col("x0"), mid.alias("_mid"), F.explode(F.array(*[F.lit(x) for x in bands])).alias("_band")
    )
    here = [*page, "_band", "_strip"]
    both = left.withColumn("_left", F.lit(None).cast("double")).withColumn("_side", F.lit(1)).unionByName(
        marks.withColumns({"_left": -F.col("x0"), "_reach": F.lit(0.0), "_side": F.lit(2)})
    ).withColumn("_strip", F.floor(F.col("_mid") / strip))
    seen = with_scans(both, here, [pos, "_side", "x0"], {"_nearest": RunMax(F.col("_left"))}).where("_side = 1")
    sure = F.coalesce(-F.col("_nearest") < F.col("x0"), F.lit(False))
    settled = seen.where(sure).select(*page, pos)
    # Reach is at most two strips, so it ends within the two strips on either side.
    around = marks.select(
        *page, "_band", F.col(pos).alias("_bpos"), F.col("x0").alias("_bx"), F.col("_mid").alias("_by"),
        F.explode(F.transform(F.array(*[F.lit(i) for i in (-2, -1, 1, 2)]), lambda d: F.floor(F.col("_mid") / strip) + d)).alias("_strip"),
    )
    met = seen.where(~sure).join(around, here).where(
        (F.col("_bpos") < F.col(pos)) & (F.col("_bx") < F.col("x0")) & (F.abs(F.col("_mid") - F.col("_by")) < F.col("_reach"))
    )
    return settled.unionByName(met.select(*page, pos)).distinct()


def reconcile_delete(
    requests: DataFrame, library: DataFrame, pos: str = "pos", reason: str = "강의자료를 찾을 수 없습니다"
) -> DataFrame:
    """Each requested id is deleted once; unknown and repeated ids fail with a reason."""
    first = requests.groupBy("slide_id").agg(F.min(pos).alias("_first"))
    have = library.select("slide_id").distinct().withColumn("_known", F.lit(True))
    judged = requests.join(first, "slide_id").join(have, "slide_id", "left")
    ok = F.coalesce("_known", F.lit(False)) & (F.col(pos) == F.col("_first"))
    return judged.select(
        pos, "slide_id", F.when(ok, "deleted").otherwise("failed").alias("outcome"),
        F.when(~ok, reason).alias("reason"),
    )


def match_cancel_tokens(tokens: DataFrame, uploads: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
    """An upload is cancelled by a token parked at most ``ttl_ms`` before; a token counts once.

    Parking again renews a token, and an upload consumes it, so what matters is whether the token's
    latest event before the upload is a parking that has not expired.
    """
    parked = tokens.select("token", "ts_ms", "event_id", F.lit(0).alias("_side"))
    sent = uploads.select("token", "ts_ms", "event_id", F.lit(1).alias("_side"))
    last = F.struct(F.col("ts_ms").alias("at"), F.col("_side").alias("side"))
    seen = with_scans(
        parked.unionByName(sent), ["token"], ["ts_ms", "_side", "event_id"], {"_prev": Lag(last)}
    )
    fresh = (F.col("_prev.side") == 0) & (F.col("ts_ms") - F.col("_prev.at") < ttl_ms)
    return seen.where("_side = 1").select(
        "event_id", "token", "ts_ms", F.coalesce(fresh, F.lit(False)).alias("cancelled")
    )


def participants(moves: DataFrame, registry: DataFrame, default_lang: str = "en") -> DataFrame:
    """Who is connected, with default language and guest names as given on joining.

    ``moves`` has session_id, user_id, ts_ms and type (join or leave) from the start of each session. A guest's
    number is that of the viewers connected with them just after they joined, and stays when others leave.
    """
    step = F.when(F.col("type") == "join", 1).otherwise(-1).cast("long")
    counted = with_scans(moves, ["session_id"], ["ts_ms", "type", "user_id"], {"_viewers": RunSum(step)})
    last = F.max_by(F.struct("type", "ts_ms", "_viewers"), F.struct("ts_ms", "type"))
    here = counted.groupBy("session_id", "user_id").agg(last.alias("_m")).where("_m.type = 'join'").select(
        "session_id", "user_id", F.col("_m.ts_ms").alias("joined_ms"), F.col("_m._viewers").alias("_no")
    )
    name = F.coalesce(T.blank_to_null(F.col("name")), F.concat(F.lit("Guest"), F.col("_no").cast("string")))
    return here.join(registry.select("user_id", "name", "audio_lang"), "user_id").select(
        "session_id", "user_id", "joined_ms", name.alias("name"),
        F.coalesce(T.blank_to_null(F.col("audio_lang")), F.lit(default_lang)).alias("audio_lang"),
    )
