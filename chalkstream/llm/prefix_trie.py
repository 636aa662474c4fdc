"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

The first eight turns of a conversation are one row with their turn ids in columns t1 to t8, the next eight are another row,
and so on. ``GROUP BY block, prior node, ROLLUP(t1, ..., t8)`` aggregates all prefixes that end in the block together,
and ``grouping_id`` tells how long each is. The prior node is the prefix that ends where the block begins; its key is a
running sum of two 64-bit digests of (position, turn id), so a row's key needs no pass per block, and a conversation
of any length is cut into rows that scans can deal over tasks.

A node belongs to its smallest member, and that conversation owns every deeper node on its path. So what a subtree holds
is a sum over its members: childless nodes and children are counted by their owners, and the bytes of a subtree's
distinct turns are what its members own. The second ROLLUP adds this up over the owners; nothing goes up level by level.

The ids of conversations that end in a node are hashed in numeric order: ranges of (node, id) are joined to pieces in
parallel, then one task feeds a node's pieces to the digest one after the other, since SHA-256 cannot be merged.

Defined results: null roles and texts are empty; turns are ordered by turn (nulls first), then role and text; repeated
rows are turns of their own; rows without ``conv_id`` belong to no conversation and are left out; an empty table
gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scans import KeyMax, KeySum, RowNumber, RunSum, with_scans
from . import params
from .lookups import lookup
from .staging import stage

_B = params.TRIE_COLUMNS
_T = [f"t{i}" for i in range(1, _B + 1)]
_S = [f"s{i}" for i in range(1, _B + 1)]
_KEY = "decimal(38,0)"


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``pos`` from 1, ``tid`` (digest of role and text) and ``bytes`` of the text."""
    said = rows.select(
        rows[conv_id].cast("long").alias("conv_id"), rows[turn].alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    numbered = with_scans(said, ["conv_id"], ["turn", "role", "text"], {"pos": RowNumber()})
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    tid = F.unhex(F.substring(F.sha2(whole, 256), 1, 32))
    return numbered.select("conv_id", "pos", tid.alias("tid"), F.octet_length("text").cast("long").alias("bytes"))


def share_heads(said: DataFrame, group: int, most: int) -> DataFrame:
    """Turns of conversations that begin with the first h turns of the first one of their group (see the contract of
    op13): conversation c takes them from c - c % ``group``, h is crc32 of c modulo ``most``; its own turns from h + 1
    on follow. Every conversation has a row; those without turns have one with a null ``pos``."""
    said = stage(said, "turns")
    convs = stage(said.groupBy("conv_id").agg(F.max("pos").alias("n")), "conversations")

    def taken(conv_id: Column) -> Column:
        return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(most))

    near = F.transform(F.sequence(F.lit(1 - group), F.lit(group - 1)), lambda k: F.try_add(F.col("conv_id"), k.cast("long")))
    heads = (
        said.filter(F.col("pos") < most).select(F.col("conv_id").alias("from"), F.explode(near).alias("conv_id"), "pos", "tid", "bytes")
        .filter((F.col("conv_id") - F.col("conv_id") % group == F.col("from")) & (F.col("pos") <= taken(F.col("conv_id"))))
        .join(convs.select("conv_id"), "conv_id", "left_semi").select("conv_id", "pos", "tid", "bytes")
    )
    h = taken(F.col("conv_id"))
    own = said.filter(F.col("pos") > h).withColumn("from", F.col("conv_id") - F.col("conv_id") % group)
    had = convs.select(F.col("conv_id").alias("from"), "n")
    moved = F.least(h, F.coalesce("n", F.lit(0))) + F.col("pos") - h
    tails = own.join(had, "from", "left").select("conv_id", moved.cast("long").alias("pos"), "tid", "bytes")
    built = stage(heads.union(tails), "rebuilt")
    empty = convs.select("conv_id").join(built.select("conv_id"), "conv_id", "left_anti")
    return built.union(empty.select("conv_id", F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("long")))


def _digest(which: int, pos: Column, tid: Column) -> Column:
    return F.xxhash64(F.lit(which), pos.cast("long"), tid).cast("decimal(20,0)")


def _blocks(said: DataFrame) -> DataFrame:
    """A row per conversation and block of turns: ids t1.., bytes from each turn to the end s1.., the key of the prior node
    (pa, pb) and of the whole prefix (fa, fb), turns of the conversation (len)."""
    slot = F.pmod(F.col("pos") - 1, F.lit(_B)) + 1
    wide = said.groupBy("conv_id", F.coalesce(F.floor((F.col("pos") - 1) / _B), F.lit(0)).cast("long").alias("block")).agg(
        *[F.max(F.when(slot == i, F.col("tid"))).alias(t) for i, t in enumerate(_T, 1)],
        *[F.coalesce(F.max(F.when(slot == i, F.col("bytes"))), F.lit(0)).alias(s) for i, s in enumerate(_S, 1)],
        F.count("pos").alias("here"),
        *[F.coalesce(F.sum(F.when(F.col("pos").isNotNull(), _digest(k, F.col("pos"), F.col("tid")))), F.lit(0)).cast(_KEY).alias(c)
          for k, c in ((1, "ha"), (2, "hb"))],
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"),
    )
    placed = with_scans(wide, ["conv_id"], ["block"], {
        "pa": RunSum(F.col("ha"), inclusive=False), "pb": RunSum(F.col("hb"), inclusive=False), "upto": RunSum(F.col("size")),
        "total": KeySum(F.col("size")), "len": KeySum(F.col("here")), "end": KeyMax(F.col("block")),
    })
    after = F.col("total") - F.col("upto")
    rest = [after + sum((F.col(s) for s in _S[i:]), F.lit(0)) for i in range(_B)]
    return placed.select(
        "conv_id", "block", *_T, *[r.alias(s) for r, s in zip(rest, _S, strict=True)], "total", "len",
        *[F.col(c).cast(_KEY).alias(c) for c in ("pa", "pb")],
        F.when(F.col("block") == F.col("end"), F.col("here")).alias("ends"),
        *[(F.col(p) + F.col(h)).cast(_KEY).alias(f) for p, h, f in (("pa", "ha", "fa"), ("pb", "hb", "fb"))],
    )


def _by_level(name: str, start: int = 0) -> str:
    """The column ``name``k of the level k of a rolled up row."""
    return "CASE level " + " ".join(f"WHEN {k} THEN {name}{k}" for k in range(start, _B + 1)) + " END"


def _rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes ending in each block; a row's ``level`` is the number of its turns in the block. Rows that end inside a
    block would be counted again as prefixes with missing turns; the root is the only prefix of no turn."""
    t = ", ".join(_T)
    rolled = rows.sparkSession.sql(
        f"SELECT block, pa, pb, {t}, {_B} - bit_count(grouping_id()) AS level, min(conv_id) AS owner, {aggregates} "
        f"FROM {{rows}} GROUP BY block, pa, pb, ROLLUP({t})", rows=rows,
    )
    there = " ".join(f"WHEN {k} THEN {t} IS NOT NULL" for k, t in enumerate(_T, 1))
    return rolled.filter(f"CASE level WHEN 0 THEN block = 0 {there} END")


def _nodes(blocks: DataFrame) -> DataFrame:
    """Nodes with their keys and those of their parents, members, ends, and bytes their members say from there on."""
    rolled = _rolled_up(blocks, ", ".join([
        "count(*) AS n_convs", "sum(total) AS said0", *[f"sum({s}) AS said{i}" for i, s in enumerate(_S, 1)],
        *[f"count_if(ends = {k}) AS ends{k}" for k in range(_B + 1)],
    ]))
    depth = F.col("block") * _B + F.col("level")

    def key(prior: str, which: int, level: Column) -> Column:
        steps = F.array(*[_digest(which, F.col("block") * _B + k, F.col(t)) for k, t in enumerate(_T, 1)])
        return F.aggregate(F.slice(steps, 1, level), F.col(prior), lambda a, x: (a + x).cast(_KEY))

    level = F.col("level")
    return rolled.select(
        depth.alias("depth"), "owner", "n_convs", key("pa", 1, level).alias("ka"), key("pb", 2, level).alias("kb"),
        key("pa", 1, F.greatest(level - 1, F.lit(0))).alias("ua"), key("pb", 2, F.greatest(level - 1, F.lit(0))).alias("ub"),
        F.expr(_by_level("said")).alias("said"), F.expr(_by_level("ends")).alias("n_ends"),
    )


def _owned(blocks: DataFrame, owners: DataFrame) -> DataFrame:
    """Children, childless nodes and bytes of distinct turns of every subtree, by owner and depth of its top."""
    rows = blocks.drop("fa", "fb", "ends").join(owners, "conv_id")
    first = F.col("first")
    at = first - F.col("block") * _B
    whole = F.when(first == 0, F.col("total")).otherwise(F.element_at(F.array(*_S), at.cast("int")))
    # The bytes a conversation owns altogether are read from the block in which its first own node lies.
    owns = rows.filter(F.col("block") == F.floor(F.greatest(first - 1, F.lit(0)) / _B)).select("conv_id", whole.alias("owns"))
    rows = rows.join(owns, "conv_id")
    cells = []
    for k in range(_B + 1):
        depth = F.col("block") * _B + k
        said = F.col(_S[k - 1]) if k else F.col("total")
        cells.append(F.when(first <= depth, said).otherwise(F.col("owns")).alias(f"o{k}"))
        cells.append(((first <= depth + 1) & (F.col("len") >= depth + 1)).cast("long").alias(f"c{k}"))
    sums = [f"sum({x}{k}) AS {y}{k}" for x, y in (("o", "owned"), ("c", "children")) for k in range(_B + 1)]
    rolled = _rolled_up(rows.select("conv_id", "block", "pa", "pb", *_T, "leaf", *cells), ", ".join(["sum(leaf) AS leaves", *sums]))
    return rolled.select(
        F.col("owner").alias("o_owner"), (F.col("block") * _B + F.col("level")).alias("o_depth"), F.col("leaves").alias("n_leaves"),
        F.expr(_by_level("owned")).alias("owned"), F.expr(_by_level("children")).alias("n_children"),
    )


_PIECE = 1024  # ids in a piece


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node, in order, joined to pieces."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    out: list[tuple] = []
    for node, members in groupby(rows, key=lambda r: r[:3]):
        ids: list[int] = []
        for r in members:
            ids.append(r[3])
            if len(ids) == _PIECE:
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if len(out) >= 1024:
            yield _rows_batch(out)
            out = []
    yield _rows_batch(out)


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    key = pa.decimal128(38, 0)
    kinds = [pa.int64(), key, key, pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "a", "b", "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node, fed with the node's pieces in order."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    out: list[tuple] = []
    for node, pieces in groupby(rows, key=lambda r: r[:3]):
        sha = hashlib.sha256()
        for i, r in enumerate(pieces):
            sha.update(("," if i else "").encode() + r[4].encode())
        out.append((*node, 0, sha.hexdigest()))
        if len(out) >= 1024:
            yield _rows_batch(out)
            out = []
    yield _rows_batch(out)


def _end_digests(blocks: DataFrame) -> DataFrame:
    ends = stage(blocks.filter("ends is not null").select(F.col("len").alias("d"), F.col("fa").alias("a"), F.col("fb").alias("b"), "conv_id"), "ends")
    schema = f"d long, a {_KEY}, b {_KEY}, first long, piece string"
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(parts, "d", "a", "b", "conv_id").sortWithinPartitions("d", "a", "b", "conv_id").mapInArrow(_pieces, schema)
    dealt = stage(pieces, "pieces").repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "first")
    return dealt.mapInArrow(_digests, schema).select("d", "a", "b", F.col("piece").alias("sha"))


def nodes(said: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in ``said`` (``conv_id``, ``pos``, ``tid``, ``bytes``; a null ``pos``
    marks a conversation without turns): ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    blocks = stage(_blocks(said), "blocks")
    found = stage(_nodes(blocks), "nodes")
    owners = stage(found.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("first"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf")
    ), "owners")
    summed = found.join(_owned(blocks, owners), (F.col("owner") == F.col("o_owner")) & (F.col("depth") == F.col("o_depth")))
    # Below its first own node a conversation owns the parents too; only first nodes look for theirs.
    # Such a parent has other members too, and may have any number of children: a salted lookup.
    above = found.filter("n_convs > 1").select((F.col("depth") + 1).alias("p_depth"), F.col("ka").alias("p_a"), F.col("kb").alias("p_b"), F.col("owner").alias("p_owner"))
    top = found.join(owners, (F.col("owner") == F.col("conv_id")) & (F.col("depth") == F.col("first"))).filter("depth > 0")
    parents = lookup(top, above, {"depth": "p_depth", "ua": "p_a", "ub": "p_b"}, F.col("owner"))
    parents = parents.select(F.col("owner").alias("t_owner"), F.col("depth").alias("t_depth"), "p_owner")
    rows = summed.join(parents, (F.col("owner") == F.col("t_owner")) & (F.col("depth") == F.col("t_depth")), "left")
    rows = rows.join(_end_digests(blocks), (F.col("depth") == F.col("d")) & (F.col("ka") == F.col("a")) & (F.col("kb") == F.col("b")), "left")
    return rows.select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("p_owner", "owner")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", (F.col("said") - F.col("owned")).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
