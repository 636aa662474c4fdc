"""Column expressions over text. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim any whitespace, not only spaces: the characters of ``\\s``, without a pattern that is tried at every character."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def matches_any(c: Column, patterns: list[str], flags: str = "") -> Column:
    """One compiled alternation instead of a test per pattern."""
    prefix = f"(?{flags})" if flags else ""
    return c.rlike(prefix + "|".join(f"(?:{p})" for p in patterns))


def contains_any(c: Column, phrases: list[str]) -> Column:
    return any_of([c.contains(p) for p in phrases])


def count_class(c: Column, chars: str) -> Column:
    """Number of characters of a class such as ``가-힣``."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]", ""))


def has_class(c: Column, chars: str) -> Column:
    return c.rlike(f"[{chars}]")


def words(c: Column, separators: str = r"\s+") -> Column:
    return F.filter(F.split(c, separators), lambda w: w != "")


def same_run(c: Column, n: int) -> Column:
    """True if ``n`` equal words stand in a row."""
    return c.rlike(rf"(?<!\S)(\S+)(?:\s+\1){{{n - 1}}}(?!\S)")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def safe_stem(c: Column, forbidden: str) -> Column:
    """Name without forbidden or control characters, trimmed."""
    escaped = "".join("\\" + ch for ch in forbidden)
    return F.regexp_replace(strip(F.regexp_replace(c, f"[{escaped}]", "")), r"\p{Cntrl}", "")
