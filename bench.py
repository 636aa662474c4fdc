"""Seconds per query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Results go to the no-op sink, so every row is computed and none is fetched. ``BENCH_QUERIES`` (names
separated by commas) restricts the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chalkstream.queries import registry  # noqa: E402
from chalkstream.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(registry.QUERIES)
    spark = local_session(cpus)
    # Warm the JVM and the Python workers, so that the first query is not charged for them.
    for name in ("lecture_summary", "frame_batches"):
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.time()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        except Exception as e:  # keep the line complete
            seconds[name] = None
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(s for s in seconds.values() if s is not None), 3)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
