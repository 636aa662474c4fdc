"""Ordered scans per key that survive a key holding a large share of all rows.

A scan is a running value along an order within a key: row number, previous or next row, running
sum or maximum, last value seen, or the last n values. When the largest key fits one task, each
scan is a plain window over (keys, order). When it does not, rows are range-partitioned on
(keys, order), so a hot key is spread over many blocks of about equal size. Each block is windowed
alone and receives what the earlier blocks of its key hand over. A block boundary divides at most
one key, so that table holds at most two rows per block, and broadcasting it is bounded by the
number of partitions, not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sizes import group_sizes, rows_per_task

_BLOCK = "_block"


@dataclass(frozen=True)
class RowNumber:
    """1-based position in the order."""


@dataclass(frozen=True)
class Lag:
    """Value of the previous row."""

    value: Column


@dataclass(frozen=True)
class Lead:
    """Value of the next row."""

    value: Column


@dataclass(frozen=True)
class RunSum:
    """Running sum; 0 before the first row when exclusive."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunMax:
    """Running maximum, nulls skipped."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class LastSeen:
    """Last non-null value so far."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Total:
    """Number of rows of the key."""


@dataclass(frozen=True)
class KeySum:
    """Sum over all rows of the key."""

    value: Column


@dataclass(frozen=True)
class KeyMax:
    """Maximum over all rows of the key."""

    value: Column


@dataclass(frozen=True)
class Tail:
    """The last ``n`` non-null values up to this row, oldest first."""

    value: Column
    n: int


Scan = RowNumber | Lag | Lead | RunSum | RunMax | LastSeen | Total | KeySum | KeyMax | Tail


def _local(scan: Scan, part, order) -> Column:
    """The scan inside one window partition. Lag and Lead come wrapped, so that a null value and
    a missing neighbour stay apart."""
    w = part.orderBy(*order)
    if isinstance(scan, RowNumber):
        return F.row_number().over(w).cast("long")
    if isinstance(scan, Lag):
        return F.lag(F.struct(scan.value.alias("v"))).over(w)
    if isinstance(scan, Lead):
        return F.lead(F.struct(scan.value.alias("v"))).over(w)
    if isinstance(scan, Total):
        return F.count(F.lit(1)).over(part)
    if isinstance(scan, KeySum):
        return F.sum(scan.value).over(part)
    if isinstance(scan, KeyMax):
        return F.max(scan.value).over(part)
    if isinstance(scan, Tail):
        return F.collect_list(scan.value).over(w.rowsBetween(-(scan.n - 1), 0))
    frame = w.rowsBetween(W.unboundedPreceding, 0 if scan.inclusive else -1)
    if isinstance(scan, RunSum):
        s = F.sum(scan.value).over(frame)
        return s if scan.inclusive else F.coalesce(s, F.lit(0))
    if isinstance(scan, RunMax):
        return F.max(scan.value).over(frame)
    return F.last(scan.value, ignorenulls=True).over(frame)


def _unwrap(scan: Scan, c: Column) -> Column:
    return c.getField("v") if isinstance(scan, (Lag, Lead)) else c


def _partial(scan: Scan, order: list[str]) -> Column:
    """What a block contributes to its neighbours."""
    at = F.struct(*order)
    if isinstance(scan, (RowNumber, Total)):
        return F.count(F.lit(1))
    if isinstance(scan, Lag):
        return F.max_by(F.struct(scan.value.alias("v")), at)
    if isinstance(scan, Lead):
        return F.min_by(F.struct(scan.value.alias("v")), at)
    if isinstance(scan, (RunSum, KeySum)):
        return F.sum(scan.value)
    if isinstance(scan, (RunMax, KeyMax)):
        return F.max(scan.value)
    if isinstance(scan, LastSeen):
        return F.max_by(scan.value, F.when(scan.value.isNotNull(), at))
    raise TypeError(scan)


def _carry(scan: Scan, c: Column, keys: list[str]) -> Column:
    """Combine the partials of the other blocks of the key."""
    part = W.partitionBy(*keys)
    by = part.orderBy(_BLOCK)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    if isinstance(scan, RowNumber):
        return F.sum(c).over(before)
    if isinstance(scan, RunSum):
        return F.sum(c).over(before)
    if isinstance(scan, (RunMax,)):
        return F.max(c).over(before)
    if isinstance(scan, (Lag, LastSeen)):
        return F.last(c, ignorenulls=True).over(before)
    if isinstance(scan, Lead):
        return F.first(c, ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing))
    if isinstance(scan, (Total, KeySum)):
        return F.sum(c).over(part)
    if isinstance(scan, KeyMax):
        return F.max(c).over(part)
    if isinstance(scan, Tail):
        return F.collect_list(c).over(before)
    raise TypeError(scan)


def _merge(scan: Scan, local: Column, carry: Column) -> Column:
    if isinstance(scan, RowNumber):
        return local + F.coalesce(carry, F.lit(0))
    if isinstance(scan, RunSum):
        return F.when(carry.isNull(), local).otherwise(F.coalesce(local, F.lit(0)) + carry)
    if isinstance(scan, RunMax):
        return F.greatest(local, carry)
    if isinstance(scan, (Total, KeySum, KeyMax)):
        return F.coalesce(carry, local)
    if isinstance(scan, Tail):
        both = F.concat(F.coalesce(F.flatten(carry), F.slice(local, 1, 0)), local)
        return F.slice(both, F.greatest(F.lit(1), F.size(both) - (scan.n - 1)), F.lit(scan.n))
    return F.coalesce(local, carry)


MAX_BLOCKS = 50_000  # beyond this many tasks blocks grow instead; windows and folds inside stream


def block_count(rows: int, limit: int) -> int:
    return min(MAX_BLOCKS, max(2, -(-rows // limit)))


def split_blocks(df: DataFrame, keys: list[str], order: list[str], blocks: int) -> DataFrame:
    """Rows range-partitioned on (keys, order) with the block number, written once."""
    ranged = df.repartitionByRange(blocks, *keys, *order).withColumn(_BLOCK, F.spark_partition_id())
    return cut_lineage(ranged)


def with_scans(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    scans: dict[str, Scan],
    limit: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add one column per scan. ``order`` must be a total order within the key (ascending).

    ``sizes`` is what ``group_sizes`` found for these keys (or coarser ones, an upper bound); an operator
    of several scans counts its input once and passes it on.
    """
    limit = rows_per_task(df.sparkSession) if limit is None else limit
    top, rows = sizes or group_sizes(df, keys)
    if top <= limit:
        part = W.partitionBy(*keys)
        return df.withColumns({n: _unwrap(s, _local(s, part, order)) for n, s in scans.items()})

    split = split_blocks(df, keys, order, block_count(rows, limit))
    by = [*keys, _BLOCK]
    plain = {n: s for n, s in scans.items() if not isinstance(s, Tail)}
    partials = split.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), *[_partial(s, order).alias(n) for n, s in plain.items()]
    )
    # The last values of a block: numbered from its end, so only n rows per block are gathered.
    for n, s in scans.items():
        if isinstance(s, Tail):
            from_end = W.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
            tail = (
                split.where(s.value.isNotNull())
                .withColumn("_back", F.row_number().over(from_end))
                .where(F.col("_back") < s.n)
                .groupBy(*by)
                .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("k"), s.value.alias("v")))).alias(n))
                .withColumn(n, F.transform(n, lambda x: x["v"]))
            )
            partials = partials.join(tail, by, "left")
    spanning = partials.withColumn("_parts", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("_parts > 1")
    carried = spanning.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(_BLOCK).alias("_kb"),
        *[_carry(s, F.col(n), keys).alias(f"_c_{n}") for n, s in scans.items()],
    )
    part = W.partitionBy(*by)
    local = split.withColumns({f"_l_{n}": _local(s, part, order) for n, s in scans.items()})
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col(_BLOCK) == F.col("_kb"),
    )
    joined = local.join(F.broadcast(carried), on, "left")
    return joined.select(
        *df.columns,
        *[_unwrap(s, _merge(s, F.col(f"_l_{n}"), F.col(f"_c_{n}"))).alias(n) for n, s in scans.items()],
    )
