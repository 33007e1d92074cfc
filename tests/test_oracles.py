"""Every query with SQL against DuckDB, every other one for a stable schema, on the smallest tables."""

import math
import os

import duckdb
import pytest

from kelpworks.plans import all_queries, all_sql


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


def check(spark, con, small, name, queries, sql):
    df = queries[name](spark, small)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    if name not in sql:
        return
    t = con.execute(sql[name])
    names = [d[0] for d in t.description]
    assert sorted(names) == cols
    other = [tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in t.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(other, key=key)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, small, name):
    check(spark, con, small, name, all_queries(), all_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["path", "line", "text", "before", "after", "matches"]
    assert set(e.oracle_sql()) <= set(e.queries())
