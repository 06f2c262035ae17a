"""Registered queries against their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Long model fits: their operators have their own tests, tools/check_queries.py runs these queries.
SLOW = {"gbt_forecast", "gbt_early_stop", "run_forecast", "rf_importance"}


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 90


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 20 and "z" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, duck, name):
    got = QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = Counter(tuple(text(r[i]) for i in order) for r in cursor.fetchall())
    assert Counter(tuple(text(r[c]) for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_without_sql_has_rows(spark, folder, name):
    assert len(QUERIES[name](spark, folder).collect()) > 0  # every column is worked out
