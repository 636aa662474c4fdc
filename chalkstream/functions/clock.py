"""Time texts and epoch arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, truncated."""
    return F.unix_millis(ts.cast("timestamp"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with negative times at zero and milliseconds truncated."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(whole / 3600),
        F.floor((whole % 3600) / 60),
        whole % 60,
        F.floor((s - whole) * 1000),
    )


def minute_time(seconds: Column) -> Column:
    """MM:SS of whole seconds (truncated toward zero)."""
    t = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(t / 60), t % 60)
