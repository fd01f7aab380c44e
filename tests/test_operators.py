"""Record operators, and the plans they give."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from shapeloom import functions as J
from shapeloom.operators import aggregate_children, element_at, nest, number_test, order_by, project, range_rows, root, where_all, where_numbers


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([("A1", 50.0, [(10.0,)]), ("A2", 200.0, [(30.0,), (40.0,), (50.0,)]), ("A3", 150.0, [(100.0,)])], "order_id string, price double, items array<struct<price:double>>")


def plan(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


def test_filter_and_project(orders):
    out = project(where_numbers(orders, ("price", ">", 100)), {"id": "order_id", "total": J.sum_of("items.price")})
    assert [tuple(r) for r in out.collect()] == [("A2", 120.0), ("A3", 100.0)] and out.columns == ["id", "total"]


def test_missing_number_is_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 50.0), (3, 500.0)], "id int, price double")
    for test, value, ids in [("<", 100, [1, 2]), (">", 100, [3]), (">=", 0, [1, 2, 3]), ("=", 0, [1]), ("!=", 0, [2, 3]), ("<=", -1, [])]:
        assert [r.id for r in where_numbers(df, ("price", test, value)).collect()] == ids, (test, value)


def test_truthy_filters(spark):
    df = spark.createDataFrame([(1, "", True), (2, "x", None), (3, "y", True)], "id int, s string, b boolean")
    assert [r.id for r in where_all(df, "s", "b", F.col("id") > 0).collect()] == [3]


def test_scan_gets_filters_and_columns(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, [(1.0, "x")])], "id int, price double, items array<struct<price:double,name:string>>").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = plan(where_numbers(df, ("price", "<", 100)).select("id"))
    assert "Or(LessThan(price,100.0),IsNull(price))" in text and "items" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "items:array<struct<price:double>>" in plan(df.select(J.sum_of("items.price")))


def test_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, 2, 5.0), (1, 1, None)], "p int, n int, v double")
    out = aggregate_children(parents, children, "id", "p", {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("average", "v")})
    assert sorted(map(tuple, out.collect())) == [(1, 5.0, 2.0, 0.0, 5.0, 2.5), (2, 0.0, 0.0, 0.0, 0.0, 0.0)]
    nested = {r.id: r["items"] for r in nest(parents, children, "id", "p", "items", "n").collect()}
    assert [tuple(x) for x in nested[1]] == [(1, None), (2, 5.0)] and nested[2] is None


def test_order_and_index(orders, spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, -1.0), (4, 5.0)], "id int, v double")
    assert [r.id for r in order_by(df, ">v", ordinal="id").collect()] == [2, 4, 1, 3]
    assert [r.id for r in order_by(df, "v", "<v", ordinal="id").collect()] == [3, 1, 2, 4]
    assert element_at(df, 1, ["id"]).first().id == 2
    assert element_at(df, 0, ["id"], number_test("v", ">", 1)).count() == 0
    assert element_at(df, 9, ["id"]).count() == 0
    with pytest.raises(ValueError):
        element_at(df, -1, ["id"])
    assert "TakeOrderedAndProject" in plan(element_at(df, 1, ["id"])) or "GlobalLimit" in plan(element_at(df, 1, ["id"]))


def test_bindings_ranges_roots(spark, orders):
    out = project(orders, {"x": "b"}, {"a": J.multiply("price", 2), "b": J.add("a", 1)})
    assert [r.x for r in out.collect()] == [101.0, 401.0, 301.0]
    with pytest.raises(ValueError):
        project(orders, {}, {"price": F.lit(1)})
    assert [r.value for r in range_rows(spark, 0, 3).collect()] == [0, 1, 2, 3] and range_rows(spark, 3, 1).count() == 0
    assert root(spark, {"v": F.lit(1) + 1}).first().v == 2


@pytest.mark.parametrize("name, pushed", [("filter_truthy", ["IsNotNull(event_type)", "Not(EqualTo(event_type,))"]), ("filter_and_or_in", ["In(o_orderstatus, [O,P])", "Or(GreaterThan(o_totalprice,100000.0)"])])
def test_queries_push_their_filters(spark, name, pushed):
    from shapeloom.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.split("\n") if "PushedFilters" in x).split("PushedFilters: ")[1]
    assert all(p in line for p in pushed), line


def test_contained_in_is_never_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    from shapeloom.functions import contained_in

    assert [tuple(r) for r in df.select(contained_in("x", ["a"]), contained_in("x", ["a", None])).collect()] == [(True, True), (False, True), (False, False)]
