"""A fold over a stream: the state of each key lives in Spark's state store.

The same step objects as in batch (``plans.folds``) are used, so a stream and its batch twin cannot
drift apart. A micro-batch is bounded by the source's rate limit; its rows of a key are put in order
before they are walked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful_fold(
    stream: DataFrame, keys: list[str], order: list[str], fold, event_time: str | None = None, idle_ms: int = 0
) -> DataFrame:
    """Add the fold's outputs to every row of the stream.

    With ``event_time`` (a watermarked column) and ``idle_ms``, a key that stays silent that long is
    forgotten. A step may return ``None`` as state to forget its key at once.
    """
    schema = T.StructType([*stream.schema.fields, *fold.out_fields])
    state_schema = T.StructType([T.StructField("state", T.StringType())])
    outs = [f.name for f in fold.out_fields]
    cols = list(fold.inputs)
    timed = event_time is not None and idle_ms > 0

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        current = json.loads(state.get[0]) if state.exists else fold.start()
        results = []
        for row in zip(*[rows[c].tolist() for c in cols]):
            if current is None:
                current = fold.start()
            current, out = fold.step(current, row)
            results.append(out)
        if current is None and state.exists:
            state.remove()
        elif current is not None:
            state.update((json.dumps(current),))
            if timed:
                last = int(rows[event_time].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        for j, name in enumerate(outs):
            rows[name] = [r[j] for r in results]
        yield rows

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", timeout)
