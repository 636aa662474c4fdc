"""Findings of round 4: what failed before."""

from collections import Counter

import duckdb
import pytest

from chalkstream.queries.registry import ORACLES, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def both(spark, path, name, rows):
    """Rows of a query over these documents (id, text, lang), and those of its SQL."""
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], DOCUMENTS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    got = QUERIES[name](spark, str(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    return Counter(map(tuple, got.collect())), Counter(want)


@pytest.mark.parametrize("odd", [None, "", "  ", "\n\r\n", "\t\f", "a,\x0bb c\x0bd", "a\x01b, \x01c\x01 d", "\x01"])
def test_phrases_of_odd_texts_are_those_of_the_sql(spark, tmp_path, odd):
    got, want = both(spark, tmp_path, "split_phrases", [(1, odd, "en"), (2, "one two three four five. six", "en")])
    assert got == want
    assert got[2, 2, "six"] == 1


def test_reasons_are_those_of_the_sql(spark, tmp_path):
    odd = [(i, t, "en") for i in range(60) for t in ("", "a\n\nb ###\n", "\r", "\x85", None)]
    got, want = both(spark, tmp_path / "lines", "reason_counts", odd)
    assert got == want and not any("courtesy" in r for r in got)
    # A line of an id that stands twice counts for both languages; one without an id has none.
    texts = ["a ###\nb", "c", ""]
    ids = [(1, "en"), (1, "fr"), (2, None), (None, "en"), (None, None), (3, "de"), (3, "de"), (4, "es")]
    got, want = both(spark, tmp_path / "ids", "reason_counts", [(k, texts[i % 3], lang) for i, (k, lang) in enumerate(ids)])
    assert got == want and sum(n * r[2] for r, n in got.items()) == 14
