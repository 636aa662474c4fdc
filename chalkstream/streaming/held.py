"""Folds over a stream in event-time order, whatever order its files arrive in.

Rows wait in Spark's state store, by stretch of event time, until the watermark has passed the end of their stretch; a
timer then lets the stretch go, in order, through the same step objects as in batch (``plans.folds``). Keys share
buckets, so a call to the store moves the rows or states of many keys: with a call for each key, its round trips took
nearly all of the time. A bucket's state is what the fold keeps of its keys, the rows of the stretches still open, and
nothing else: no more than a stretch of a bucket is in memory at once, and a key silent for ``idle`` is forgotten. Rows
later than the watermark are left out by Spark, which counts them (``numRowsDroppedByWatermark``); ``late_rows`` reads
the count of a finished run.

Spark needs the RocksDB state store for this operator; it is set for the session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Spark hands rows over as named tuples, whose names cannot begin with an underscore.
_MS, _KEY, _BUCKET, _NULLS = "held_ms", "held_key", "held_bucket", "held_nulls"


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _Held(StatefulProcessor):
    """Stretches of rows per bucket of keys, let go by timers."""

    def __init__(self, fold, order: list[str], bits: dict[str, int], stretch_ms: int, idle_ms: int):
        self.fold, self.order, self.bits, self.stretch, self.idle = fold, order, bits, stretch_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long, part long", "rows binary")
        self.kept = handle.getValueState("kept", "states string")
        self.meta = handle.getValueState("meta", "parts long, forget_ms long")

    def _meta(self) -> tuple:
        return tuple(self.meta.get()) if self.meta.exists() else (0, 0)

    def _states(self) -> dict:
        """Key to its state and the time it is forgotten."""
        return json.loads(self.kept.get()[0]) if self.kept.exists() else {}

    def _keep(self, states: dict, parts: int) -> None:
        if states:
            self.kept.update((json.dumps(states),))
        elif self.kept.exists():
            self.kept.clear()
        forget = min((at for _, at in states.values()), default=0)
        self.meta.update((parts, forget))
        if forget:
            self.handle.registerTimer(forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, forget = self._meta()
        for frame in rows:
            for stretch, some in frame.groupby(frame[_MS] // self.stretch):
                self.waiting.updateValue((int(stretch), parts), (_packed(some),))
                self.handle.registerTimer((int(stretch) + 1) * self.stretch)
                parts += 1
        self.meta.update((parts, forget))
        return iter([])

    def _column(self, rows: pd.DataFrame, name: str) -> pd.Series:
        """A column with its nulls, which travel as bits beside whole numbers, so that these stay exact."""
        null = (rows[_NULLS].to_numpy() >> self.bits[name]) & 1 if name in self.bits else None
        if null is None or not null.any():
            return rows[name]
        return rows[name].astype(object).mask(null.astype(bool), float("nan"))

    def _let_go(self, rows: pd.DataFrame, states: dict, forget: int) -> pd.DataFrame:
        by = pd.DataFrame({c: self._column(rows, c) for c in self.order}).sort_values(self.order, kind="stable").index
        rows = rows.loc[by].reset_index(drop=True)
        results = []
        inputs = zip(*[self._column(rows, c).tolist() for c in self.fold.inputs], strict=True)
        for key, row in zip(rows[_KEY].tolist(), inputs, strict=True):
            state = states[key][0] if key in states else self.fold.start()
            state, out = self.fold.step(state, row)
            if state is None:
                states.pop(key, None)
            else:
                states[key] = (state, forget)
            results.append(out)
        for j, f in enumerate(self.fold.out_fields):
            rows[f.name] = pd.Series([r[j] for r in results], dtype=object)
        return rows.drop(columns=[_MS, _KEY, _BUCKET])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        places = sorted(tuple(k) for k in self.waiting.keys())
        due: dict[int, list[tuple]] = {}
        for place in places:
            if (place[0] + 1) * self.stretch <= now:
                due.setdefault(place[0], []).append(place)
        parts, forget = self._meta()
        if not due:
            if 0 < forget <= now:
                self._forget(now, places, parts)
            return
        states = self._states()
        for stretch, some in due.items():
            frames = [_unpacked(bytes(self.waiting.getValue(p)[0])) for p in some]
            for p in some:
                self.waiting.removeKey(p)
            yield self._let_go(pd.concat(frames, ignore_index=True), states, (stretch + 1) * self.stretch + self.idle)
        self._keep(states, parts)

    def _forget(self, now: int, places: list[tuple], parts: int) -> None:
        """Keys whose time has come are dropped, save those with rows that wait."""
        awaited: set = set()
        for p in places:
            awaited.update(_unpacked(bytes(self.waiting.getValue(p)[0]))[_KEY])
        states = self._states()
        # A key with rows that wait gets its new time when they are let go.
        left = {k: (s, at if at > now else now + 1) for k, (s, at) in states.items() if at > now or k in awaited}
        self._keep(left, parts)

    def close(self) -> None:
        pass


def held_fold(
    stream: DataFrame, keys: list[str], order: list[str], fold, event_time: str, stretch: str = "1 minute", idle: str = "1 day",
    buckets: int = 128,
) -> DataFrame:
    """Add the fold's outputs to every row of a stream watermarked on ``event_time``.

    ``order`` must agree with event time and may only break its ties. Rows without event time or from before 1970 have no
    place in the order and are left out. A key whose newest row is older than the
    watermark by ``idle`` is forgotten; a step may return ``None`` as state to begin its key anew. Keys are dealt to
    ``buckets`` by hash; a task holds the states of one bucket and its rows of one stretch, so more keys want more buckets."""
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, _ROCKSDB)
    whole = [f.name for f in stream.schema.fields if isinstance(f.dataType, T.IntegralType)]
    if len(whole) > 62:
        raise ValueError("at most 62 columns of whole numbers")
    bits = {c: i for i, c in enumerate(whole)}
    ms = F.unix_millis(event_time)
    key = F.to_json(F.struct(*[F.col(k) for k in keys]))
    nulls = sum((F.col(c).isNull().cast("long") * F.lit(1 << i) for c, i in bits.items()), F.lit(0).cast("long"))
    timed = stream.where(ms >= 0).withColumns(
        {
            _MS: ms, _KEY: key, _NULLS: nulls,
            # Also keeps the bucket nullable in every batch, as the state store compares its schema with the one of the batch before.
            _BUCKET: F.when(ms >= 0, F.pmod(F.xxhash64(key), F.lit(buckets))),
            **{c: F.coalesce(c, F.lit(0).cast(stream.schema[c].dataType)) for c in whole},
        }
    )
    out = T.StructType([*stream.schema.fields, T.StructField(_NULLS, T.LongType()), *fold.out_fields])
    held = _Held(fold, order, bits, _millis(stretch), _millis(idle))
    rows = timed.groupBy(_BUCKET).transformWithStateInPandas(held, out, "append", "eventtime")
    restored = {c: F.when(F.col(_NULLS).bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.col(c)) for c, i in bits.items()}
    return rows.withColumns(restored).drop(_NULLS)


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


class Ending:
    """The end of a stream that is known to end, such as a folder whose files are complete.

    Its own small stream, joined to the data's, stays empty until ``announce`` writes one row whose event time lies
    after all others, so that the watermark passes what still waits."""

    def __init__(self, spark: SparkSession, event_time: str = "ts"):
        self.spark, self.event_time = spark, event_time
        self.path = f"{checkpoint_dir(spark)}/ending-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def joined(self, stream: DataFrame, late: str) -> DataFrame:
        """The stream with its watermark, and the ending in it. Call it last: filters behind it would take the ending out."""
        end = self.spark.readStream.schema(T.StructType([T.StructField(self.event_time, T.TimestampType())])).parquet(self.path)
        return stream.unionByName(end, allowMissingColumns=True).withWatermark(self.event_time, late)

    def announce(self) -> None:
        last = self.spark.range(1).select(F.lit("2200-01-01").cast("timestamp").alias(self.event_time))
        last.write.mode("append").parquet(self.path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
