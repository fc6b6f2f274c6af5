"""Every registered query against its SQL, on the smallest scale factor."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.queries import ORACLES, QUERIES
from workload.views import TABLES, VIEWS, duckdb_with, view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view_is_equal_on_both_engines(spark, duck, name):
    ours = view(spark, SF, name)
    theirs = duck.sql(duckdb_with([name]) + f"SELECT * FROM {name}")
    assert rows_of(ours.collect(), ours.columns) == rows_of(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours.collect(), ours.columns) == rows_of(theirs.fetchall(), theirs.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
