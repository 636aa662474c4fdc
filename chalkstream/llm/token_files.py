"""Token ids of a corpus as files of range-coded blocks, in ascending document order.

Layout below a path:

* ``table``: ids and frequencies shared by all blocks (at most one row per id of the vocabulary).
* ``blocks/part=N``: Parquet rows ``start`` (ids of all documents before the block), ``doc_ids``, ``lengths`` and
  ``block``, the coded bytes (see ``rans``). Parts, and blocks by ``start``, follow the order of ``doc_id``.

Texts are range-partitioned by ``doc_id`` once and encoded in order; the ids are written out, counted, and coded
block by block. Every block is decoded without the others, and every segment of a block from its checkpoint.

Defined results: null and empty texts are the end id alone; null ids come first; rows with one
``doc_id`` stand next to each other in the order of their text's hash; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params, rans, tokens
from .staging import new_folder, stage
from .wordhash import texts_of
from .worker import give_back

_CHUNK = "part int, before long, doc_ids array<long>, lengths array<int>, ids binary, seen array<int>, times array<long>"
_BLOCK = "part int, start long, doc_ids array<long>, lengths array<int>, block binary"
_DOC = "doc_id long, start long, n_tokens long, ids_crc32 long"
CHARS = 1 << 20  # characters cut up at once


def _int_lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


class _Chunks:
    """Encodes texts in order and cuts the ids into chunks of whole documents. The last chunk of a part says how often
    the part has each id."""

    def __init__(self, path: str, known: int, chars: int = CHARS):
        self.path, self.known, self.chars = path, known, chars

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        cut = tokens.IdCutter(self.path, self.known)
        end = np.array([params.END_ID], cut.kind).tobytes()
        before, ids, lengths, parts = 0, [], [], []
        counts = np.zeros(0, np.int64)

        def chunk(is_last: bool) -> pa.RecordBatch:
            nonlocal counts
            joined = b"".join(parts)
            counts = _added(counts, np.bincount(np.frombuffer(joined, cut.kind)))
            seen = np.flatnonzero(counts) if is_last else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before]), _int_lists([ids], pa.int64()),
                 _int_lists([lengths], pa.int32()), pa.array([joined], pa.binary()),
                 _int_lists([seen], pa.int32()), _int_lists([counts[seen]], pa.int64())],
                ["part", "before", "doc_ids", "lengths", "ids", "seen", "times"],
            )

        size = 0
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for some in tokens.batched((t.as_py() for t in texts_of(batch.column(1))), self.chars):
                for found in cut.of_texts(some):
                    if size >= params.BLOCK_TOKENS:
                        yield chunk(False)
                        before, size, ids, lengths, parts = before + size, 0, [], [], []
                    ids.append(next(names))
                    parts += (found.tobytes(), end)
                    lengths.append(len(found) + 1)
                    size += lengths[-1]
        if ids:
            yield chunk(True)
        give_back()


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    a[: len(b)] += b
    return a


class _Encode:
    def __init__(self, table: rans.Table, offsets: dict[int, int]):
        self.table, self.offsets = table, offsets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                part, before = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                ids = row.column(4)[0].as_buffer()
                width = ids.size // pc.sum(row.column(3)[0].values).as_py()  # every document has its end id
                ids = np.frombuffer(ids, f"<u{width}")
                yield pa.RecordBatch.from_arrays(
                    [row.column(0), pa.array([self.offsets[part] + before]), row.column(2), row.column(3),
                     pa.array([rans.encode(ids, self.table)], pa.binary())],
                    ["part", "start", "doc_ids", "lengths", "block"],
                )


class _Digests:
    def __init__(self, table: rans.Table):
        self.table = table

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = rans.slot_places(self.table)
        for batch in batches:
            for i in range(len(batch)):
                ids = rans.decode(batch.column(3)[i].as_py(), self.table, slots).astype("<u4")
                lengths = np.array(batch.column(2)[i].as_py(), np.int64)
                end = np.cumsum(lengths)
                if end[-1] != len(ids):
                    raise ValueError("a block does not hold the ids of its documents")
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(end, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + end - lengths), pa.array(lengths),
                     pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def write(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    known: int = tokens.IDS_KNOWN, chars: int = CHARS,
) -> None:
    """Encode all texts and write the files below ``path``. A worker remembers the ids of twice ``known`` cuts at most and
    cuts up about ``chars`` characters at once."""
    vocabulary = tokenizer or public_tokenizers.path(params.TOKENIZER)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_mark")]
    ordered = rows.withColumn("_mark", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = stage(ordered.select("doc_id", "text").mapInArrow(_Chunks(vocabulary, known, chars), _CHUNK), "token-chunks")
    counts = chunks.select(F.explode(F.arrays_zip("seen", "times")).alias("c")).groupBy(F.col("c.seen").cast("long").alias("id"))
    found = counts.agg(F.sum("c.times").alias("n")).orderBy("id").collect()  # one row per id of the vocabulary at most
    frequencies = rans.quantise(np.array([r["n"] for r in found], np.int64))
    table = [(r["id"], int(f)) for r, f in zip(found, frequencies, strict=True)]
    spark = docs.sparkSession
    spark.createDataFrame(table, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    # One row per partition of the shuffle.
    sizes = chunks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    offsets, upto = {}, 0
    for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offsets[r["part"]] = upto
        upto += r["n"]
    blocks = chunks.drop("seen", "times").mapInArrow(_Encode(_table(table), offsets), _BLOCK)
    blocks.write.option("compression", "none").partitionBy("part").parquet(f"{path}/blocks")


def _table(rows: list[tuple[int, int]]) -> rans.Table:
    return rans.Table.of(np.array([i for i, _ in rows], np.int64), np.array([f for _, f in rows], np.int64))


def read_table(spark: SparkSession, path: str) -> rans.Table:
    return _table([(r["id"], r["frequency"]) for r in spark.read.parquet(f"{path}/table").orderBy("id").collect()])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from its decoded ids: where they start, how many there are, and their CRC-32."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "block")
    return blocks.mapInArrow(_Digests(read_table(spark, path)), _DOC)


def write_and_read(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: int = tokens.IDS_KNOWN, chars: int = CHARS
) -> DataFrame:
    path = new_folder(docs.sparkSession, "token-files")
    write(docs, path, doc_id, text, known=known, chars=chars)
    return digests(docs.sparkSession, path)
