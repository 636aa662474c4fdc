"""Ordered folds per key: the next value depends on the previous output.

Spark partitions and sorts; a small numpy/Python step then walks each sorted partition once, with
the state of the open key as its only memory. Three kinds of step:

* ``Affine``: ``state = min(hi, max(lo, a * state + b))`` with per-row coefficients (moving
  averages, rise-at-once and fall-slowly delays);
* ``Automaton``: a step over a handful of states (batching, packing);
* ``Sequential``: anything else, where keys are small by construction.

Affine maps compose into affine maps, and an automaton block is known from one run per start
state. So when the largest key is too big for one task, rows are range-partitioned on
(keys, order), each block is summarised alone, the summaries (at most two per block boundary) give
every block its entering state, and the blocks are walked in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import _BLOCK, block_count, split_blocks
from .sizes import group_sizes, rows_per_task

INF = float("inf")


@dataclass(frozen=True)
class Affine:
    """Inputs a, b, lo, hi (doubles, a >= 0); output the new state."""

    inputs: tuple[str, str, str, str]
    output: str
    init: float = 0.0

    @property
    def out_fields(self):
        return [T.StructField(self.output, T.DoubleType())]

    def start(self):
        return (self.init,)

    def step(self, state, row):
        a, b, lo, hi = row
        x = min(hi, max(lo, a * state[0] + b))
        return (x,), (x,)

    def no_effect(self):
        return [1.0, 0.0, -INF, INF]

    def absorb(self, summary, row):
        a1, b1, lo1, hi1 = summary
        a, b, lo, hi = row

        def through(v):
            return min(hi, max(lo, (a * v if a else 0.0) + b))

        return [a * a1, a * b1 + b, through(lo1), through(hi1)]

    def enter(self, summary, state):
        a, b, lo, hi = summary
        return (min(hi, max(lo, a * state[0] + b)),)


@dataclass(frozen=True)
class Automaton:
    """States 0..n-1 plus a running count. ``move(s, row) -> (next, counted, flag)``: ``counted`` is
    added to the count before the row's output (count, flag, next) is taken."""

    inputs: tuple[str, ...]
    outputs: tuple[str, str, str]
    states: int
    move: Callable = field(compare=False)

    @property
    def out_fields(self):
        return [T.StructField(n, T.LongType()) for n in self.outputs]

    def start(self):
        return (0.0, 0.0)

    def step(self, state, row):
        nxt, counted, flag = self.move(int(state[0]), row)
        total = int(state[1]) + counted
        return (float(nxt), float(total)), (total, flag, nxt)

    def no_effect(self):
        return [v for s in range(self.states) for v in (float(s), 0.0)]

    def absorb(self, summary, row):
        out = []
        for i in range(0, len(summary), 2):
            nxt, counted, _ = self.move(int(summary[i]), row)
            out += [float(nxt), summary[i + 1] + counted]
        return out

    def enter(self, summary, state):
        i = 2 * int(state[0])
        return (summary[i], state[1] + summary[i + 1])


@dataclass(frozen=True)
class Sequential:
    """Any step ``(state, row) -> (state, outputs)``; ``first()`` gives the state of a new key.
    For keys whose size is bounded by what they are (one page, one dense run of repeats)."""

    inputs: tuple[str, ...]
    out_fields: list[T.StructField]
    first: Callable = field(compare=False)
    move: Callable = field(compare=False)

    def start(self):
        return self.first()

    def step(self, state, row):
        return self.move(state, row)


def _walk(keys: list[str], fold, entering: bool):
    """Walk a partition sorted by (keys, order); memory is one Arrow batch and one state."""

    outs = [f.name for f in fold.out_fields]
    cols = list(fold.inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = _walk
        state = None
        for pdf in batches:
            key_rows = list(zip(*[pdf[k].tolist() for k in keys])) if keys else [()] * len(pdf)
            inputs = zip(*[pdf[c].tolist() for c in cols])
            enters = pdf["_enter"].tolist() if entering else None
            result: list[tuple] = []
            for i, (key, row) in enumerate(zip(key_rows, inputs)):
                if key != current:
                    current = key
                    given = enters[i] if enters is not None else None
                    state = tuple(given) if given is not None else fold.start()
                state, out = fold.step(state, row)
                result.append(out)
            drop = [c for c in ("_enter", _BLOCK) if c in pdf.columns]
            pdf = pdf.drop(columns=drop)
            for j, name in enumerate(outs):
                pdf[name] = [r[j] for r in result]
            yield pdf

    return run


def _summarise(keys: list[str], fold):
    cols = list(fold.inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = _summarise
        block = 0
        summary: list[float] = []

        def row_out():
            return {**dict(zip(keys, current)), _BLOCK: [block], "_sum": [summary]}

        for pdf in batches:
            key_rows = list(zip(*[pdf[k].tolist() for k in keys])) if keys else [()] * len(pdf)
            blocks = pdf[_BLOCK].tolist()
            for i, (key, row) in enumerate(zip(key_rows, zip(*[pdf[c].tolist() for c in cols]))):
                if key != current:
                    if current is not _summarise:
                        yield pd.DataFrame(row_out())
                    current, block, summary = key, blocks[i], fold.no_effect()
                summary = fold.absorb(summary, row)
        if current is not _summarise:
            yield pd.DataFrame(row_out())

    return run


def _entering(keys: list[str], fold):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_BLOCK)
        state = fold.start()
        states = []
        for summary in pdf["_sum"]:
            states.append([float(v) for v in state])
            state = fold.enter(list(summary), state)
        return pdf.drop(columns="_sum").assign(_enter=states)

    return run


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], fold, limit: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add the fold's outputs to every row. ``sizes``: see ``scans.with_scans``."""
    schema = T.StructType([*df.schema.fields, *fold.out_fields])
    limit = rows_per_task(df.sparkSession) if limit is None else limit
    splittable = not isinstance(fold, Sequential)
    top, rows = (sizes or group_sizes(df, keys)) if splittable else (0, 0)
    if top <= limit:
        placed = df.repartition(*keys) if keys else df.repartition(1)
        return placed.sortWithinPartitions(*keys, *order).mapInPandas(_walk(keys, fold, False), schema)

    split = split_blocks(df, keys, order, block_count(rows, limit))
    within = split.sortWithinPartitions(*keys, *order)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    sums = within.mapInPandas(
        _summarise(keys, fold),
        T.StructType(
            [*key_fields, T.StructField(_BLOCK, T.IntegerType()), T.StructField("_sum", T.ArrayType(T.DoubleType()))]
        ),
    )
    grouped = sums.groupBy(*keys) if keys else sums.groupBy(F.lit(0))
    states = grouped.applyInPandas(
        _entering(keys, fold),
        T.StructType(
            [*key_fields, T.StructField(_BLOCK, T.IntegerType()), T.StructField("_enter", T.ArrayType(T.DoubleType()))]
        ),
    )
    # Only blocks after the first of their key need a state: at most one per block boundary.
    first = states.groupBy(*keys).agg(F.min(_BLOCK).alias("_first")) if keys else states.agg(F.min(_BLOCK).alias("_first"))
    later = states.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_BLOCK).alias("_kb"), "_enter"
    )
    renamed = first.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "_first")
    cond = reduce(
        lambda a, b: a & b,
        [F.col(f"_k_{k}").eqNullSafe(F.col(f"_f_{k}")) for k in keys],
        F.col("_kb") > F.col("_first"),
    )
    later = later.join(renamed, cond).select(*[f"_k_{k}" for k in keys], "_kb", "_enter")
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col(_BLOCK) == F.col("_kb"),
    )
    placed = split.join(F.broadcast(later), on, "left").select(*df.columns, _BLOCK, "_enter")
    return placed.sortWithinPartitions(*keys, *order).mapInPandas(_walk(keys, fold, True), schema)


def per_small_group(
    df: DataFrame, keys: list[str], order: list[str], inputs: list[str], rows_of: Callable, schema: T.StructType
) -> DataFrame:
    """``rows_of(key, rows) -> rows`` for groups that are small by what they are (one page). Partitions
    are sorted once and streamed; one group is held at a time, and many groups share a batch."""

    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for pdf in batches:
            out: list[tuple] = []
            for key, row in zip(zip(*[pdf[k].tolist() for k in keys]), zip(*[pdf[c].tolist() for c in inputs])):
                if key != current:
                    if held:
                        out += rows_of(current, held)
                    current, held = key, []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(rows_of(current, held), columns=names)

    return df.select(*dict.fromkeys([*keys, *order, *inputs])).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
