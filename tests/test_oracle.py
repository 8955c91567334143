"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from linkspark.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v if isinstance(v, (int, type(None))) else str(v)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    spark.catalog.clearCache()
