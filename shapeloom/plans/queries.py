"""Queries over the driver's tables, one or more for each operator and function, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as J
from ..functions.combine import HOLE
from ..functions.objects import json_keys, parse
from ..operators import aggregate_children, element_at, nest, number_test, order_by, project, range_rows, root, where_all, where_numbers
from ..sources import Catalog, Provider, elements, parse_documents
from . import errors, responses, validation
from . import requests as R
from .services import Context, Services

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(name: str, table: str, fields: dict, sql: str) -> None:
    """A query that projects columns of one table."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return project(_t(spark, sf_dir, table), {k: v() if callable(v) else v for k, v in fields.items()})

    QUERIES[name], SQL[name] = f, f"SELECT {sql} FROM {table}"


# -- records: filters, projections, aggregates of children, order ------------------------------------------------


@_register("""SELECT o_orderkey AS id, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey
              WHERE o_totalprice > 100000 GROUP BY o_orderkey
              UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_totalprice > 100000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def fetch_filter_project(spark, sf_dir):
    """Orders above a price, each with the sum of its items' prices."""
    orders = where_numbers(_t(spark, sf_dir, "orders"), ("o_totalprice", ">", 100_000))
    with_total = aggregate_children(orders, _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", {"sum": ("sum", "l_extendedprice")})
    return project(with_total, {"id": "o_orderkey", "total": F.round("sum", 2)})


_columns("projection_only", "orders", {"id": "o_orderkey", "prio": "o_orderpriority"}, "o_orderkey AS id, o_orderpriority AS prio")


@_register("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'P') AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')")
def filter_and_or_in(spark, sf_dir):
    kept = where_all(_t(spark, sf_dir, "orders"), J.contained_in("o_orderstatus", ["O", "P"]), number_test("o_totalprice", ">", 100_000) | (F.col("o_orderpriority") == "1-URGENT"))
    return project(kept, {"id": "o_orderkey", "status": "o_orderstatus"})


@_register("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) WHERE v < 5 OR v IS NULL")
def filter_null_as_zero(spark, sf_dir):
    holes = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return where_numbers(holes, ("v", "<", 5))


@_register("SELECT event_id FROM events WHERE event_type <> '' AND event_type IS NOT NULL AND event_id % 3 <> 0")
def filter_truthy(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("rest", F.col("event_id") % 3)
    return where_all(events, "event_type", "rest").select("event_id")


@_register("""SELECT c_custkey, coalesce(round(sum(o_totalprice), 2), 0) AS total, CAST(count(o_orderkey) AS DOUBLE) AS n, coalesce(min(o_totalprice), 0) AS least,
              coalesce(max(o_totalprice), 0) AS most, coalesce(round(avg(o_totalprice), 6), 0) AS mean FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def aggregate_all(spark, sf_dir):
    """Every aggregate over a customer's orders; 0 without orders."""
    number = "o_totalprice"
    fields = {"total": ("sum", number), "n": ("count", number), "least": ("min", number), "most": ("max", number), "mean": ("average", number)}
    out = aggregate_children(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey", fields)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    return nest(_t(spark, sf_dir, "orders").select("o_orderkey"), items, "o_orderkey", "l_orderkey", "items", "l_linenumber")


@_register("""SELECT o_orderkey, coalesce(round(sum(l_extendedprice), 2), 0) AS total, CAST(count(l_orderkey) AS DOUBLE) AS n, coalesce(min(l_extendedprice), 0) AS least,
              coalesce(max(l_extendedprice), 0) AS most, coalesce(round(avg(l_extendedprice), 6), 0) AS mean FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nested_aggregates(spark, sf_dir):
    """Every aggregate over an order's items; partial sums, no order's items in one row."""
    number = "l_extendedprice"
    fields = {"total": ("sum", number), "n": ("count", number), "least": ("min", number), "most": ("max", number), "mean": ("average", number)}
    out = aggregate_children(_t(spark, sf_dir, "orders").select("o_orderkey"), _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", fields)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@_register("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY place LIMIT 10")
def order_by_top(spark, sf_dir):
    """The ten largest orders; the place shows their order."""
    top = order_by(_t(spark, sf_dir, "orders"), ">o_totalprice", ordinal="o_orderkey").limit(10)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("k"), "o_orderkey", "o_totalprice"))).alias("x"))
    return listed.select(F.posexplode("x").alias("p", "x")).select("x.o_orderkey", "x.o_totalprice", (F.col("p") + 1).alias("place"))


@_register("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def order_by_all(spark, sf_dir):
    return order_by(_t(spark, sf_dir, "customer"), "c_nationkey", ">c_acctbal", ordinal="c_custkey").select("c_custkey", "c_nationkey", "c_acctbal")


@_register("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 1) WHERE o_totalprice > 0")
def index_n(spark, sf_dir):
    """The sixth order, if its price is above 0."""
    return element_at(_t(spark, sf_dir, "orders"), 5, ["o_orderkey"], number_test("o_totalprice", ">", 0)).select("o_orderkey", "o_totalprice")


# -- numbers ----------------------------------------------------------------------------------------------------

_columns("arithmetic", "lineitem", {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "net": lambda: F.round(J.multiply("l_extendedprice", J.subtract(1, "l_discount")), 4),
    "unit": lambda: F.round(J.divide("l_extendedprice", "l_quantity"), 8), "total": lambda: F.round(J.add("l_extendedprice", "l_tax"), 2),
}, """l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice / l_quantity, 8) AS unit,
      round(l_extendedprice + l_tax, 2) AS total""")  # fmt: skip
_columns("divide_by_zero", "events", {"event_id": "event_id", "q": lambda: J.string(J.divide(J.subtract("event_id", 5), F.lit(0)))},
         "event_id, CASE WHEN event_id > 5 THEN 'Infinity' WHEN event_id < 5 THEN '-Infinity' ELSE 'NaN' END AS q")
_columns("modulo", "part", {"p_partkey": "p_partkey", "m": lambda: J.modulo(J.negate("p_size"), 7), "none": lambda: J.modulo("p_size", 0)},
         "p_partkey, CAST(-p_size % 7 AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS none")
_columns("conditional", "orders", {"o_orderkey": "o_orderkey", "band": lambda: F.when(number_test("o_totalprice", ">", 100_000), "high").otherwise("low")},
         "o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band")
_columns("number_functions", "customer", {
    "c_custkey": "c_custkey", "a": lambda: J.abs_("c_acctbal"), "f": lambda: J.floor("c_acctbal"), "c": lambda: J.ceil("c_acctbal"), "r": lambda: J.round_("c_acctbal"),
    "p": lambda: J.power(F.lit(2.0), "c_nationkey"), "s": lambda: F.round(J.sqrt(J.abs_("c_acctbal")), 6), "n": lambda: J.negate("c_acctbal"),
}, """c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(c_acctbal) AS r, pow(2.0, c_nationkey) AS p,
      round(sqrt(abs(c_acctbal)), 6) AS s, -c_acctbal AS n""")  # fmt: skip
_columns("round_digits", "customer", {"c_custkey": "c_custkey", "r": lambda: J.round_("c_acctbal", 1)}, "c_custkey, round(c_acctbal * 10) / 10 AS r")
_columns("number", "customer", {
    "c_custkey": "c_custkey", "text": lambda: J.number(F.regexp_extract("c_name", "([0-9]+)$", 1)), "no": lambda: J.number("c_name"),
    "yes": lambda: J.number(F.col("c_acctbal") > 0), "blank": lambda: J.number(F.lit(" 42")),
}, """c_custkey, coalesce(TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS DOUBLE), 0) AS text, 0.0::DOUBLE AS no,
      CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS yes, 0.0::DOUBLE AS blank""")  # fmt: skip

# -- text -------------------------------------------------------------------------------------------------------

# numbers of one digit from 1e-8 to 9e21
_SCALED = lambda: F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("E"), (F.col("p_partkey") % 30 - 8).cast("string")).cast("double")
_SCALED_SQL = """CASE WHEN p_partkey % 30 - 8 >= 21 THEN p_size % 9 + 1 || 'e+' || (p_partkey % 30 - 8) WHEN p_partkey % 30 - 8 >= 0 THEN p_size % 9 + 1 || repeat('0', p_partkey % 30 - 8)
                   WHEN p_partkey % 30 - 8 >= -6 THEN '0.' || repeat('0', 7 - p_partkey % 30) || (p_size % 9 + 1) ELSE p_size % 9 + 1 || 'e-0' || (8 - p_partkey % 30) END"""
_columns("string", "part", {"scaled": lambda: J.string(_SCALED()), "money": lambda: J.string(F.col("p_size") + 12345678.25), "p_partkey": "p_partkey", "whole": lambda: J.string(F.col("p_size").cast("double")), "text": lambda: J.string("p_name"), "half": lambda: J.string(F.col("p_size") + 0.5), "none": lambda: J.string(F.lit(None).cast("double"))},
         f"{_SCALED_SQL} AS scaled, p_size + 12345678 || '.25' AS money, p_partkey, CAST(p_size AS VARCHAR) AS whole, p_name AS text, CAST(p_size AS VARCHAR) || '.5' AS half, '' AS none")
_columns("concat", "part", {"p_partkey": "p_partkey", "s": lambda: J.concat("p_name", F.lit(" / "), F.col("p_size").cast("double"), F.lit(None).cast("string"), _SCALED())},
         f"p_partkey, p_name || ' / ' || p_size || ({_SCALED_SQL}) AS s")
_columns("case_and_trim", "part", {"p_partkey": "p_partkey", "u": lambda: J.uppercase("p_name"), "l": lambda: J.lowercase("p_brand"), "t": lambda: J.trim(F.concat(F.lit(" \t\n"), F.col("p_name"), F.lit(" \r\n ")))},
         "p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(p_name) AS t")
_columns("length", "documents", {"doc_id": "doc_id", "n": lambda: J.length("text")}, "doc_id, CAST(length(text) AS DOUBLE) AS n")
_columns("substring", "part", {
    "p_partkey": "p_partkey", "a": lambda: J.substring("p_name", 2), "b": lambda: J.substring("p_name", 1, 3), "c": lambda: J.substring("p_name", -3),
    "d": lambda: J.substring("p_name", -1000, 3), "e": lambda: J.substring("p_name", 1000), "f": lambda: J.substring("p_name", 1, -1),
}, """p_partkey, substr(p_name, 3) AS a, substr(p_name, 2, 3) AS b, right(p_name, 3) AS c, left(p_name, 3) AS d, '' AS e, '' AS f""")
_columns("substring_around", "customer", {
    "c_custkey": "c_custkey", "a": lambda: J.substring_before("c_name", "#"), "b": lambda: J.substring_after("c_name", "#"), "c": lambda: J.substring_before("c_name", "?"),
    "d": lambda: J.substring_after("c_name", "?"), "e": lambda: J.contains("c_name", "1"),
}, """c_custkey, CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, 1, strpos(c_name, '#') - 1) ELSE c_name END AS a,
      CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, strpos(c_name, '#') + 1) ELSE c_name END AS b, c_name AS c, c_name AS d, contains(c_name, '1') AS e""")  # fmt: skip
_columns("pad", "part", {"p_partkey": "p_partkey", "a": lambda: J.pad("p_brand", 12, "#"), "b": lambda: J.pad("p_brand", 3), "c": lambda: J.pad("p_brand", 12, "")},
         "p_partkey, CASE WHEN length(p_brand) < 12 THEN rpad(p_brand, 12, '#') ELSE p_brand END AS a, p_brand AS b, CASE WHEN length(p_brand) < 12 THEN rpad(p_brand, 12, ' ') ELSE p_brand END AS c")
_columns("split_join", "part", {"p_partkey": "p_partkey", "n": lambda: J.count_of(J.split("p_name", " ")), "a": lambda: J.join(J.split("p_name", " "), "+"), "b": lambda: J.join(J.split("p_brand", "")), "c": lambda: J.join(J.split(F.concat("p_brand", F.lit(".")), "."), "|")},
         "p_partkey, CAST(len(string_split(p_name, ' ')) AS DOUBLE) AS n, replace(p_name, ' ', '+') AS a, array_to_string(string_split(p_brand, ''), ',') AS b, p_brand || '|' AS c")

# -- truth and types --------------------------------------------------------------------------------------------

_columns("booleans", "events", {
    "event_id": "event_id", "n": lambda: J.boolean(F.col("event_id") % 2), "t": lambda: J.boolean(F.when(F.col("event_id") % 3 == 0, "").otherwise("x")),
    "no": lambda: J.not_(F.when(F.col("event_id") % 5 != 0, F.col("event_id"))), "there": lambda: J.exists(F.when(F.col("event_id") % 5 != 0, F.col("event_id"))), "empty": lambda: J.boolean(F.array()),
}, """event_id, event_id % 2 <> 0 AS n, event_id % 3 <> 0 AS t, (event_id % 5 = 0 OR event_id = 0) AS "no", event_id % 5 <> 0 AS there, true AS empty""")
_columns("types", "events", {
    "event_id": "event_id", "a": lambda: J.type_of("value"), "b": lambda: J.type_of("event_type"), "c": lambda: J.type_of(F.col("event_id") > 1), "d": lambda: J.type_of(F.array("event_id")),
    "e": lambda: J.type_of(F.struct("event_id")), "f": lambda: J.type_of(F.when(F.col("event_id") < 0, 1)), "g": lambda: J.type_of("ts"),
}, """event_id, CASE WHEN value IS NULL THEN 'null' ELSE 'number' END AS a, CASE WHEN event_type IS NULL THEN 'null' ELSE 'string' END AS b, 'boolean' AS c, 'array' AS d,
      'object' AS e, 'null' AS f, 'undefined' AS g""")  # fmt: skip

# -- arrays -----------------------------------------------------------------------------------------------------


@_register("SELECT CAST(range AS DOUBLE) AS index, CAST(range * range AS DOUBLE) AS square FROM range(0, 25)")
def range_map(spark, sf_dir):
    return project(range_rows(spark, 0, 24, "index"), {"index": "index", "square": J.multiply("index", "index")})


@_register("SELECT '2,4,6' AS doubled, '3,5,7' AS chained, '' AS none, '10,20' AS literals, 6.0::DOUBLE AS total, '2,3' AS kept")
def array_map(spark, sf_dir):
    one_to_three = J.number_range(1, 3)
    return root(spark, {
        "doubled": J.join(J.array_map(one_to_three, lambda x: x * 2)), "chained": J.join(J.array_map(one_to_three, lambda x: x * 2, lambda x: x + 1)), "none": J.join(J.number_range(3, 1)),
        "literals": J.join(J.array_map([1, 2], lambda x: x * 10)), "total": J.reduce_array(one_to_three, F.lit(0.0), lambda a, x: a + x), "kept": J.join(J.filter_array(one_to_three, lambda x: x > 1)),
    })


@_register("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_returnflag) AS rn FROM lineitem),
              i AS (SELECT l_orderkey, list(l_returnflag ORDER BY rn) AS f, string_agg(l_returnflag || l_linenumber, '|' ORDER BY rn) AS z FROM r GROUP BY l_orderkey),
              d AS (SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY first) AS flags FROM (SELECT l_orderkey, l_returnflag, min(rn) AS first FROM r GROUP BY ALL) GROUP BY l_orderkey)
              SELECT l_orderkey, array_to_string(list_concat(f, ['end']), ',') AS appended, flags AS different, array_to_string(list_reverse(f), ',') AS reversed,
                     array_to_string(list_sort(f), ',') AS sorted, z AS zipped
              FROM i JOIN d USING (l_orderkey)""")
def array_functions(spark, sf_dir):
    orders = _nested_orders(spark, sf_dir).where(F.size("items") > 0)
    flags, numbers = F.col("items.flag"), F.transform("items.l_linenumber", J.string)
    zipped = F.transform(J.zip_arrays(flags, numbers), lambda t: J.concat(F.element_at(t, 1), F.element_at(t, 2)))
    return orders.select(F.col("o_orderkey").alias("l_orderkey"), J.join(J.append(flags, ["end"])).alias("appended"), J.join(J.distinct(flags)).alias("different"), J.join(J.reverse(flags)).alias("reversed"), J.join(J.sort(flags)).alias("sorted"), J.join(zipped, "|").alias("zipped"))


# -- objects ----------------------------------------------------------------------------------------------------


@_register("""SELECT p_partkey, 'brand,name,size' AS keys, p_brand || ',' || p_name || ',' || p_size AS vals, 'brand,extra,name,size' AS merged_keys, 'big' AS merged_size, p_brand || '+' || p_name AS each_value,
              'brand,name' AS sifted, p_brand || ',' || p_name AS wild, p_name AS spread_name FROM part""")
def object_functions(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    m = F.create_map(F.lit("size"), J.string("p_size"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    merged = J.merge(m, F.lit(None).cast("map<string,string>"), F.create_map(F.lit("size"), F.lit("big"), F.lit("extra"), F.lit("x")))
    text = J.filter_object(m, lambda v, k: k != "size")
    part = part.withColumn("o", F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))
    return part.select(
        "p_partkey", J.join(J.keys(m)).alias("keys"), J.join(J.values(m)).alias("vals"), J.join(J.keys(merged)).alias("merged_keys"), merged["size"].alias("merged_size"), J.join(J.each_value(text, lambda v, k: v), "+").alias("each_value"),
        J.join(J.keys(text)).alias("sifted"), J.join(J.wildcard("o", part.schema["o"].dataType)).alias("wild"), J.spread("o")["name"].alias("spread_name"),
    )


@_register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS strict, CAST(NULL AS VARCHAR) AS missing, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def json_path(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "props", parse("props").alias("d"))
    return events.select("event_id", J.lookup("d", "k", "bigint").alias("k"), J.extract("d", "k", "bigint").alias("strict"), J.lookup("d", "no.such").alias("missing"), J.join(json_keys("props")).alias("keys"))


@_register("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'array' WHEN 3 THEN 'object' WHEN 4 THEN 'boolean' ELSE 'null' END AS kind,
              CASE WHEN event_id % 6 = 3 THEN 'a,b' END AS keys, CASE WHEN event_id % 6 = 3 THEN '2,1' END AS vals FROM events""")
def document_functions(spark, sf_dir):
    """Types, keys and values that only the rows know."""
    kind = F.col("event_id") % 6
    body = F.when(kind == 0, "1.5").when(kind == 1, '"x"').when(kind == 2, "[1]").when(kind == 3, '{"b":1,"a":2}').when(kind == 4, "true").otherwise("null")
    d = parse_documents(_t(spark, sf_dir, "events").select("event_id", body.alias("body")))
    listed = lambda x: F.when(x.isNotNull(), J.join(x))
    values = F.transform(J.document_values("document"), lambda v: F.try_variant_get(v, "$", "string"))
    return d.select("event_id", J.document_type("document").alias("kind"), listed(J.document_keys("document")).alias("keys"), listed(values).alias("vals"))


# -- time -------------------------------------------------------------------------------------------------------

_columns("from_millis", "events", {"event_id": "event_id", "iso": lambda: J.from_millis(F.unix_millis(F.col("ts").cast("timestamp")))},
         "event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z', '\\.?0*Z$', 'Z') AS iso")
_columns("to_millis", "events", {"event_id": "event_id", "ms": lambda: J.to_millis(J.from_millis(F.unix_millis(F.col("ts").cast("timestamp")))), "bad": lambda: J.to_millis("event_type"), "day": lambda: J.to_millis(F.lit("2024-01-15"))},
         "event_id, CAST((epoch_us(ts) // 1000) AS DOUBLE) AS ms, 0.0::DOUBLE AS bad, 0.0::DOUBLE AS day")


@_register()
def now_millis_random_shuffle(spark, sf_dir):
    return root(spark, {"now": J.now(), "millis": J.millis(), "random": J.random(), "shuffled": J.join(J.shuffle(J.number_range(1, 9)))})


# -- bindings and functions -------------------------------------------------------------------------------------


@_register("SELECT p_partkey, p_retailprice * 2 AS doubled, round(p_retailprice * 2 * 1.1, 2) AS taxed FROM part")
def bindings(spark, sf_dir):
    return project(_t(spark, sf_dir, "part"), {"p_partkey": "p_partkey", "doubled": "twice", "taxed": F.round("with_tax", 2)}, {"twice": J.multiply("p_retailprice", 2), "with_tax": J.multiply("twice", 1.1)})


@_register("SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS called, upper(p_name) || '!' AS chained, CAST(length(p_brand) AS DOUBLE) AS composed, substr(p_name, 2, 3) AS part FROM part")
def functions_of_functions(spark, sf_dir):
    double = lambda x: J.multiply(x, 2)
    shout = lambda x: J.concat(x, F.lit("!"))
    hole = HOLE
    return project(_t(spark, sf_dir, "part"), {
        "p_partkey": "p_partkey", "called": double("p_size"), "chained": J.chain("p_name", J.uppercase, shout), "composed": J.compose(J.uppercase, J.length)("p_brand"),
        "part": J.chain("p_name", J.partial(J.substring, hole, 1, 3)),
    })


# -- sources, services, requests --------------------------------------------------------------------------------


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    base = sf_dir if "://" in sf_dir else f"file://{sf_dir}"
    tables = {"endpoints": {t: f"{t}.parquet" for t in ("customer", "orders", "nation", "region")}}
    lacking = {"base_url": base, "format": "parquet", "optional": True, "endpoints": {"none": "no_such_table.parquet"}}
    return Catalog(spark, {"shop": Provider.of({"base_url": base, "format": "parquet", **tables}), "lacking": Provider.of(lacking)})


@_register("SELECT c_custkey AS id, c_name AS name, coalesce(sum(o_totalprice), 0) > 500000 AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY c_custkey, c_name")
def service_compose(spark, sf_dir):
    """A service that asks another for a nation's customers."""
    services = Services()
    services.add("customers", lambda c: c.catalog.fetch("shop", "customer").where(F.col("c_nationkey") == c.param("nation.key")))
    services.add("large", lambda c: aggregate_children(c.service("customers", nation={"key": 3}), c.catalog.fetch("shop", "orders"), "c_custkey", "o_custkey", {"total": ("sum", "o_totalprice")}))
    out = services.run("large", Context(services, _catalog(spark, sf_dir)))
    return project(out, {"id": "c_custkey", "name": "c_name", "large": F.col("total") > 500_000})


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per event."""
    m = lambda *kv: F.create_map(*kv)
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), m(F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("user_id").cast("string"))).alias("headers"), m(F.lit("session"), F.col("event_type")).alias("cookies"),
        m(F.lit("page"), F.col("value").cast("int").cast("string")).alias("query"), m(F.lit("customer"), F.col("user_id").cast("string")).alias("params"), F.concat(F.lit("/customers/"), F.col("user_id").cast("string")).alias("path"),
        F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("props").alias("body"),
    )


@_register("SELECT event_id AS request_id, 'Bearer ' || user_id AS auth, event_type AS session, CAST(user_id AS VARCHAR) AS id, '/customers/' || user_id AS path, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def request_context(spark, sf_dir):
    return project(_requests(spark, sf_dir), {"request_id": "request_id", "auth": R.header("Authorization"), "session": R.cookie("session"), "id": R.param("customer"), "path": "path", "method": "method", "k": R.body_field("k", "bigint")})


@_register("SELECT event_id AS request_id, c_name AS name FROM events LEFT JOIN customer ON c_custkey = user_id")
def params_lookup(spark, sf_dir):
    """Each request with the customer that its path names."""
    found = R.look_up(_requests(spark, sf_dir).select("request_id", "params"), _t(spark, sf_dir, "customer").select("c_custkey", "c_name"), R.param("customer"), "c_custkey")
    return found.select("request_id", F.col("c_name").alias("name"))


@_register("SELECT (SELECT n_name FROM nation WHERE n_nationkey = 7) AS nation, (SELECT r_name FROM region WHERE r_regionkey = 2) AS region, CAST(NULL AS VARCHAR) AS lacking")
def multi_source_object(spark, sf_dir):
    """One object from three sources, one of which is optional and isn't there."""
    c = _catalog(spark, sf_dir)
    one = lambda df: df.withColumn("request_id", F.lit(0).cast("long"))
    sources = {
        "nation": one(c.fetch("shop", "nation").where("n_nationkey = 7")), "region": one(c.fetch("shop", "region").where("r_regionkey = 2")), "lacking": one(c.fetch("lacking", "none", schema="name string")),
    }
    return R.assemble(spark.range(1).select(F.col("id").alias("request_id")), **sources).select("nation.n_name", "region.r_name", "lacking.name").toDF("nation", "region", "lacking")


@_register("""SELECT event_id, CAST(pos AS INTEGER) AS position, CAST(k AS BIGINT) AS k FROM (
                SELECT event_id, unnest(CASE event_id % 6 WHEN 0 THEN [0, 1] WHEN 1 THEN [0, 1] WHEN 2 THEN [0] WHEN 3 THEN [0] ELSE [] END) AS pos, json_extract(props, '$.k') AS k FROM events)""")
def root_shapes(spark, sf_dir):
    """Bodies of every shape: an array, an array or an object under the endpoint's name, an object, a scalar, null."""
    p, kind = F.col("props"), F.col("event_id") % 6
    listed = F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))
    under = lambda x: F.concat(F.lit('{"events":'), x, F.lit("}"))
    body = F.when(kind == 0, listed).when(kind == 1, under(listed)).when(kind == 2, under(p)).when(kind == 3, p).when(kind == 4, "42").otherwise("null")
    documents = parse_documents(_t(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return elements(documents.drop("body"), "events").select("event_id", "position", J.lookup("element", "k", "bigint").alias("k"))


# -- validation and responses -----------------------------------------------------------------------------------


@_register("""SELECT event_id AS request_id, CASE WHEN event_type = 'click' THEN 'session breaks enum [''view'', ''purchase'', ''signup'', ''scroll'']' WHEN trunc(value) < 10 THEN 'page breaks minimum 10'
                WHEN CAST(json_extract(props, '$.k') AS BIGINT) IS NULL THEN 'body.k is required' END AS error,
              CASE WHEN event_type = 'click' OR trunc(value) < 10 OR json_extract(props, '$.k') IS NULL THEN 400 ELSE 200 END AS status FROM events""")
def validation_rules(spark, sf_dir):
    rules = [
        validation.required(R.header("Authorization"), "Authorization"),
        validation.Rule(R.cookie("session") == "click", "session breaks enum ['view', 'purchase', 'signup', 'scroll']"),
        *validation.constraints(R.query("page"), "page", {"type": "integer", "minimum": 10}),
        *validation.body_rules(F.col("body"), {"required": ["k"]}),
    ]
    out = validation.validate(_requests(spark, sf_dir), rules)
    return out.select("request_id", "error.error", F.coalesce("error.status", F.lit(200)).alias("status"))


#: Of an OpenAPI document.
_COMPONENTS = {"Kind": {"$ref": "#/components/schemas/Word"}, "Word": {"type": "string", "minLength": 5, "enum": ["click", "purchase", "scroll"]}}
_OPERATION = {
    "parameters": [
        {"in": "cookie", "name": "session", "required": True, "schema": {"$ref": "#/components/schemas/Kind"}},
        {"in": "query", "name": "page", "schema": {"type": "integer", "maximum": 90}},
        {"in": "header", "name": "Authorization", "schema": {"type": "string", "maxLength": 10, "pattern": "[02468]$"}},
        {"in": "path", "name": "customer", "required": True, "schema": {"type": "string", "format": "email"}},
    ]
}


@_register("""SELECT event_id AS request_id, CASE WHEN length(event_type) < 5 THEN 'cookie session breaks minLength 5' WHEN event_type NOT IN ('click', 'purchase', 'scroll') THEN 'cookie session breaks enum [''click'', ''purchase'', ''scroll'']'
                WHEN trunc(value) > 90 THEN 'query page breaks maximum 90' WHEN length('Bearer ' || user_id) > 10 THEN 'header Authorization breaks maxLength 10' WHEN user_id % 2 = 1 THEN 'header Authorization breaks pattern [02468]$'
                WHEN event_id % 3 <> 0 THEN 'path customer is not an email' END AS error FROM events""")
def validation_schema(spark, sf_dir):
    """Length, pattern, enum, maximum, email and references, from an operation's schema."""
    user = R.param("customer")
    requests = _requests(spark, sf_dir).withColumn("params", F.create_map(F.lit("customer"), F.when(F.col("request_id") % 3 == 0, F.concat(user, F.lit("@x.org"))).otherwise(user)))
    return validation.validate(requests, validation.operation_rules(_OPERATION, _COMPONENTS)).select("request_id", "error.error")


@_register("SELECT n_nationkey, 'https://h/v1/nations/' || replace(n_name, ' ', '%20') || '/' || n_nationkey || '?k=v' AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'https://h/v1/nations/' || n_nationkey || '/' || n_nationkey || '?k=v' END AS lacking FROM nation")
def provider_urls(spark, sf_dir):
    """A url for each row, from a template and the row's parameters; none where one is missing."""
    p = Provider.of({"host": "https://h", "path": "/v1", "query": {"k": "v"}, "endpoints": {"nation": "/nations/{name}/{id}"}})
    key = F.col("n_nationkey")
    return project(_t(spark, sf_dir, "nation"), {"n_nationkey": "n_nationkey", "url": p.url_column("nation", {"name": F.col("n_name"), "id": key}), "lacking": p.url_column("nation", {"name": F.when(key % 2 == 0, key), "id": key})})


@_register("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 409 ELSE 200 END AS status, 'application/json' AS kind,
              CASE WHEN o_orderstatus = 'P' THEN '{"error":"pending","status":409,"code":"ORDER_PENDING"}' ELSE '{"id":' || o_orderkey || ',"note":null}' END AS body FROM orders""")
def http_response_and_error(spark, sf_dir):
    value = F.struct(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("note"))
    answer = F.when(F.col("o_orderstatus") == "P", responses.http_error(409, "pending", "ORDER_PENDING")).otherwise(responses.http_response(200, value))
    out = _t(spark, sf_dir, "orders").select("o_orderkey", answer.alias("a"))
    return out.select("o_orderkey", "a.status", F.col("a.headers")["Content-Type"].alias("kind"), "a.body")


@_register("""SELECT r_regionkey, '[' || string_agg('{"n":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS body FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey > 0 OR true GROUP BY r_regionkey HAVING count(*) > 1
              UNION ALL SELECT r_regionkey, '{"n":"' || any_value(n_name) || '"}' FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey HAVING count(*) = 1""")
def json_body_unwrapped(spark, sf_dir):
    """A region's nations as one JSON body; a single one stands alone."""
    items = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", F.col("n_name").alias("n"))
    return responses.collect_body(items, "r_regionkey", "n_nationkey", unwrap=True)


@_register("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Request timeout' WHEN 1 THEN 'Service temporarily unavailable' WHEN 2 THEN 'failed to fetch [url]' WHEN 3 THEN 'An error occurred processing your request' ELSE 'something failed' END AS message,
              CASE event_id % 5 WHEN 0 THEN 'UPSTREAM_TIMEOUT' WHEN 1 THEN 'UPSTREAM_UNAVAILABLE' ELSE 'INTERNAL_ERROR' END AS code FROM events""")
def error_rows(spark, sf_dir):
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, "context deadline exceeded").when(kind == 1, "dial tcp: connection refused").when(kind == 2, "failed to fetch https://internal.example.com/x").when(kind == 3, "user_service/profile: ")
    return _t(spark, sf_dir, "events").select("event_id", raw.otherwise("user_service/profile: something failed").alias("raw")).select("event_id", errors.safe_message("raw").alias("message"), errors.code_of("raw").alias("code"))


@_register("""SELECT CAST(range AS DOUBLE) AS k, repeat('#', CAST((range * (range + 1) // 2) % 17 AS INTEGER)) || ' ' || (range * (range + 1) // 2) AS line FROM range(0, 40)""")
def drawing(spark, sf_dir):
    """Bars as long as the triangular numbers modulo 17, from ranges, reductions and functions of functions."""
    triangle = lambda k: J.reduce_array(J.number_range(F.lit(1), k), F.lit(0.0), J.add)
    bar = J.compose(lambda n: J.number_range(F.lit(1), n), lambda r: J.array_map(r, lambda _: F.lit("#")), J.partial(J.join, HOLE, ""))
    return project(range_rows(spark, 0, 39, "k"), {"k": "k", "line": J.concat(bar(J.modulo("sum", 17)), F.lit(" "), J.string("sum"))}, {"sum": triangle(F.col("k"))})


# -- streams ----------------------------------------------------------------------------------------------------


@_register("SELECT event_id, upper(event_type) AS kind, round(value * 2, 2) AS twice FROM events WHERE value < 50 OR value IS NULL")
def stream_stateless(spark, sf_dir):
    """The same filter and projection over a stream of files, run to its end."""
    from ..streaming import open_stream, run_to_end, shared_folder, stateless

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    pipeline = lambda df: project(where_numbers(df, ("value", "<", 50)), {"event_id": "event_id", "kind": J.uppercase("event_type"), "twice": F.round(J.multiply("value", 2), 2)})
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run_to_end(stateless(open_stream(spark, f"{sf_dir}/events.parque[t]", schema), pipeline), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")
