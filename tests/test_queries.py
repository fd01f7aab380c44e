"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from shapeloom.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def compare(spark, query, sql, sf=SF):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    expected = c.sql(sql)
    got = query(spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda data, names: sorted(repr([r[names.index(k)] for k in columns]) for r in data)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


def test_the_rest_runs(spark):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, SF).count() == 1


def test_nested_aggregates_hold_no_order_in_one_row(spark):
    plan = queries.QUERIES["nested_aggregates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan
