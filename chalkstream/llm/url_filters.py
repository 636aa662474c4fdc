"""URL filters: rules on a host with its subdomains and the beginning of a path, longest rule first.

Every URL is expanded into expressions, one for each of its host suffixes with each of its path prefixes that end
in a slash; a rule is filed under its host and its path up to the last slash. Expressions and rules meet by the
first 32 bits of their SHA-256; full digests and the rest of the rule's path are compared afterwards. Suffixes and
prefixes longer than any rule are not formed, as no rule can be filed under them. A page's expressions are
aggregated where they were made, so one row per page is shuffled; rules go to every task behind a count of them, more
rules than that are joined by salted shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path; rules that repeat a host and path are one,
and block if any of them does; of two rules of equal length the one with the longer host wins; repeated pages are
judged one by one; without rules every page gets the default; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import lookup

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PREFIX_DIGITS = 8  # hexadecimal digits of a digest that expressions are joined on


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a URL; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _filed(rules: DataFrame) -> DataFrame:
    """Rules with the digest they are filed under and what their path has behind its last slash."""
    text = [F.coalesce(rules[c].cast("string"), F.lit("")) for c in ("host", "path")]
    one = rules.select(
        F.translate(text[0], _UPPER, _UPPER.lower()).alias("rule_host"), text[1].alias("rule_path"),
        F.lower(rules["verdict"]).alias("rule_verdict"),
    ).groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    folder = F.regexp_extract("rule_path", "(?s)^.*/", 0)
    return one.select(
        "*", F.sha2(F.concat("rule_host", folder), 256).alias("digest"),
        (_count_of(F.col("rule_host"), ".") + 1).alias("labels"), _count_of(F.col("rule_path"), "/").alias("slashes"),
    ).withColumn("prefix", F.substring("digest", 1, _PREFIX_DIGITS))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (host and path of the longest that fits, or null), ``verdict``.

    ``rules`` has host, path and verdict (allow or block)."""
    filed = _filed(rules)
    deepest = filed.agg(F.max("labels"), F.max("slashes")).first()
    most_labels, most_slashes = int(deepest[0] or 1), int(deepest[1] or 0)
    host, path = host_and_path(pages[url].cast("string"))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), pages[page_id].alias("page_id"), host.alias("host"), path.alias("path")
    )
    labels = F.least(_count_of(F.col("host"), ".") + 1, F.lit(most_labels))
    slashes = F.least(_count_of(F.col("path"), "/"), F.lit(most_slashes))
    suffixes = F.transform(
        F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), slashes),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))),
    )
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expressions = rows.select("*", F.explode(every).alias("expression")).select(
        "row", "page_id", "host", "path", F.sha2("expression", 256).alias("full")
    ).withColumn("short", F.substring("full", 1, _PREFIX_DIGITS))
    met = lookup(expressions, filed.drop("labels", "slashes"), {"short": "prefix"}, F.col("row"))
    fits = (F.col("full") == F.col("digest")) & F.col("path").startswith(F.col("rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.when(fits, F.struct(
        F.length(rule).alias("size"), F.length("rule_host").alias("host_size"), rule.alias("rule"), F.col("rule_verdict").alias("verdict")
    )))
    found = met.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return found.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
