"""Every core query runs on the smallest tables and, where SQL can express it, gives the same rows."""

import os

import duckdb
import pytest

from tidemark.plans.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | str):
        return str(v)
    try:
        return f"{float(v) + 0.0:.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert rows
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
