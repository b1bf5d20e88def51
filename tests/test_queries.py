"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items()}
CORE = sorted(entry.catalog.QUERIES)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def same(x):
    return x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x


@pytest.mark.parametrize("name", CORE)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    got = [tuple(map(same, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name not in SQL:
        assert got
        return
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = rel.select(*[duckdb.ColumnExpression(c) for c in sorted(rel.columns)]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
