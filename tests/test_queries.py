"""Every registered query against its SQL, over the whole smallest test data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from credence.testbed import catalog
from credence.testbed.tables import BASE_TABLES

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")

# Queries added by optional folders have their own tests.
QUERIES = {name: run for name, run in entry_points.queries().items() if name in catalog.QUERIES}
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    result = database.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_queries_without_sql(spark):
    assert sorted(set(QUERIES) - set(SQL)) == ["ann_recall", "ann_topk", "encode_chunks"]
    assert QUERIES["ann_recall"](spark, FOLDER).first()["recall"] >= 0.8


def test_entry(spark):
    assert entry_points.entry(spark).count() == 99
