"""Token counts by a two-tier lookup on the map side.

First tier: the token counts of the most frequent cuts (see ``tokens``), one compact table of bounded size sent to
every task. Second tier: what the table lacks is encoded and remembered in the worker. Cuts are never shuffled: each
task sums up its frequent ones in a summary of bounded size, and summaries are merged 32 at a time until
few are left. The table decides how often the library is asked, never what is counted.

Defined results: null and empty texts have 0 bytes and tokens; rows are counted one by one, whatever their ids; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import params, tokens
from .staging import stage
from .wordhash import texts_of

_SUMMARY = "at long, cuts array<string>, counts array<long>"


def _trimmed(counts: Counter, most: int) -> Counter:
    """The summary with at most ``most`` cuts: all counts are lowered by the first one left out (Misra and Gries)."""
    if len(counts) <= most:
        return counts
    top = counts.most_common(most + 1)
    low = top[-1][1]
    return Counter({c: n - low for c, n in top[:-1] if n > low}) or Counter(dict(top[:-1]))


def _row(at: int, counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([at], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())),
         pa.array([list(counts.values())], pa.list_(pa.int64()))],
        ["at", "cuts", "counts"],
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in texts_of(batch.column(0)):
            counts.update(tokens.cuts_of(text.as_py())[1:])
            if len(counts) > 16 * params.FREQUENT_CUTS:
                counts = _trimmed(counts, 8 * params.FREQUENT_CUTS)
    counts = Counter({c: n for c, n in counts.items() if c and " " not in c})
    yield _row(TaskContext.get().partitionId(), _trimmed(counts, params.FREQUENT_CUTS))


def _merged(rows: pa.Table) -> Counter:
    counts: Counter = Counter()
    for cuts, n in zip(rows.column("cuts"), rows.column("counts"), strict=True):
        counts.update(dict(zip(cuts.as_py(), n.as_py(), strict=True)))
    return _trimmed(counts, params.FREQUENT_CUTS)


def _merge_group(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_row(rows.column("at")[0].as_py() // params.MERGED_AT_ONCE, _merged(rows))])


def frequent_cuts(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent cuts of all texts; as many as the table holds."""
    rows = stage(docs.select(docs[text].cast("string")).mapInArrow(_summaries, _SUMMARY), "frequent-cuts")
    while rows.count() > params.MERGED_AT_ONCE:
        groups = rows.groupBy(F.expr(f"at div {params.MERGED_AT_ONCE}"))
        rows = stage(groups.applyInArrow(_merge_group, _SUMMARY), "frequent-cuts")
    return list(_merged(rows.toArrow()))


class _Count:
    def __init__(self, path: str, table: Broadcast):
        self.path, self.table = path, table

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, lengths = self.table.value
        cut = tokens.count_cutter(self.path, dict(zip(cuts.split(" ") if cuts else [], lengths, strict=True)))
        for batch in batches:
            texts = texts_of(batch.column(1))
            some = tokens.batched(t.as_py() for t in texts)
            found = pa.array([n for part in some for n in cut.of_texts(part)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), found, pc.greater(found, params.TOKEN_LIMIT)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def count(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row."""
    path = tokenizer or public_tokenizers.path(params.TOKENIZER)
    lib, _ = tokens.tokenizer(path)
    frequent = frequent_cuts(docs, text)
    known = [(c, n) for c in frequent if (n := len(lib.encode(tokens.text_of(c), add_special_tokens=False))) < 256]
    table = " ".join(c for c, _ in known), bytes(n for _, n in known)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(_Count(path, sent), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
