"""Whole-text JSON check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(c: Column) -> Column:
    """The text is one JSON value and nothing else. Spark's parsers stop at the end of the first value,
    so the text is read as the first of two elements of an array."""
    pair = F.from_json(F.concat(F.lit("["), c, F.lit(",0]")), "array<string>", _STRICT)
    return F.coalesce(F.slice(pair, 2, 9) == F.array(F.lit("0")), F.lit(False))
