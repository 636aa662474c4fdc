"""Every query against its SQL in DuckDB on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from chalkstream.session import TABLES

sys.path.insert(0, "tools")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    from collections import Counter

    from tools.check import norm

    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert rows
    if name in entry.oracle_sql():
        rel = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
