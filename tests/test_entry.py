"""The entry module: what is registered, and that a query's SQL gives the same rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(df):
    cols = sorted(df.columns)
    text = lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, views, name):
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(views.execute(entry.oracle_sql()[name]).fetchdf())
