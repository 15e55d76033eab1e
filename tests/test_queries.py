"""Every catalogue query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lexloom import catalogue


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.execute(f"create view {f.split('.')[0]} as select * from '{tables}/{f}'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, duck, name):
    df = catalogue.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()), key=repr)
    want = duck.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
