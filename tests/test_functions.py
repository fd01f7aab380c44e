"""Golden vectors of the column functions."""

import math
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeloom import functions as J
from shapeloom.functions.combine import HOLE
from shapeloom.functions.objects import parse


def one(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
    return tuple(row) if len(columns) > 1 else row[0]


def doubles(*xs):
    return F.array(*map(F.lit, map(float, xs))) if xs else F.array().cast("array<double>")


@pytest.mark.parametrize("xs, total, least, most, mean", [([], 0, 0, 0, 0), ([1, 2, 3], 6, 1, 3, 2), ([-1, 2, -3], -2, -3, 2, -2 / 3), ([-1, -5, 0], -6, -5, 0, -2), ([2, 4, 6], 12, 2, 6, 4)])
def test_aggregates(spark, xs, total, least, most, mean):
    a = doubles(*xs)
    assert one(spark, J.sum_of(a), J.count_of(a), J.min_of(a), J.max_of(a), J.average_of(a)) == pytest.approx((total, len(xs), least, most, mean))


def test_aggregates_of_missing_values(spark):
    holes = F.array(F.lit(2.0), F.lit(None).cast("double"))
    none = F.lit(None).cast("array<double>")
    assert one(spark, J.sum_of(holes), J.min_of(holes), J.count_of(holes), J.sum_of(none), J.count_of(none), J.average_of(none)) == (2, 0, 2, 0, 0, 0)


def test_numbers(spark):
    lit = F.lit
    assert one(spark, J.power(2, 3), J.power(10, 0), J.power(2, -1), J.sqrt(16), J.sqrt(2)) == (8, 1, 0.5, 4, math.sqrt(2))
    assert math.isnan(one(spark, J.sqrt(-1)))
    assert one(spark, J.round_(2.5), J.round_(-2.5), J.round_(1.005, 2), J.floor(-1.5), J.ceil(1.2), J.abs_(-3)) == (3, -3, 1.0, -2, 2, 3)
    assert one(spark, J.divide(5, 2), J.divide(1, 0), J.divide(-1, 0), J.modulo(-7, 3), J.modulo(7, 0)) == (2.5, math.inf, -math.inf, -1, None)
    assert math.isnan(one(spark, J.divide(0, 0)))
    assert one(spark, J.add(lit(None).cast("double"), 2), J.negate(lit(None).cast("int")), J.subtract(1, 3), J.multiply(2, 4)) == (2, 0, -2, 8)
    assert 0 <= one(spark, J.random()) < 1


def test_number(spark):
    got = one(spark, J.number(F.lit("42")), J.number(F.lit("1e3")), J.number(F.lit(" 42")), J.number(F.lit("x")), J.number(F.lit("1d")), J.number(F.lit(True)), J.number(F.lit(7)), J.number(F.lit(None).cast("string")))
    assert got == (42, 1000, 0, 0, 0, 1, 7, 0)


@pytest.mark.parametrize("value, text", [(42.0, "42"), (1e21, "1e+21"), (-0.5, "-0.5"), (0.0, "0"), (1e20, "100000000000000000000"), (7, "7"), ("x", "x"), (None, ""), (True, "true")])
def test_string(spark, value, text):
    assert one(spark, J.string(F.lit(value))) == text


def json_number(x):
    """All digits from 1e-6 up to 1e21, else an exponent of two digits at least."""
    if x == 0:
        return "0"
    digits, _, e = f"{x!r}".partition("e")
    if 1e-6 <= abs(x) < 1e21:
        text = f"{Decimal(repr(x)):f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    return f"{digits.removesuffix('.0')}e{int(e):+03d}"


def test_string_of_all_sizes(spark):
    xs = [s * float(f"{m}e{e}") for e in range(-8, 23) for m in (1.0, 1.5, 12345678.5, 9.99) for s in (1, -1)] + [0.0001, 12345678.5, 1e-7, 1000000.0, -0.0, 1e-300, 1.7976931348623157e308]
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", J.string("x").alias("s")).collect()
    assert [(r.x, r.s) for r in got] == [(r.x, json_number(r.x)) for r in got]
    assert one(spark, J.string(F.lit(float("nan"))), J.string(F.lit(float("-inf")))) == ("NaN", "-Infinity")


TEXT_FUNCTIONS = [J.trim, J.uppercase, J.lowercase, lambda x: J.substring(x, 1), lambda x: J.substring(x, -9), lambda x: J.substring_before(x, "#"), lambda x: J.substring_after(x, "#"), lambda x: J.pad(x, 20, "."),
                  lambda x: J.concat(x, F.lit("!")), J.string]


@pytest.mark.parametrize("functions", [TEXT_FUNCTIONS, *([f] * 10 for f in TEXT_FUNCTIONS)])
def test_ten_nested_text_functions_plan_fast(spark, functions):
    df = spark.createDataFrame([(" abc#def ",)], "x string")
    df.select(J.trim("x")).collect()
    began = time.perf_counter()
    df.select(J.chain("x", *functions))._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 1


def test_case_keeps_the_length(spark):
    letter = spark._jvm.java.lang.Character  # its case mappings of one letter are the simple ones
    grows = [n for n in range(0x80, 0x11000) if not 0xD800 <= n < 0xE000 and (len(chr(n).upper()) > 1 or len(chr(n).lower()) > 1)]
    assert len(grows) > 100
    words = [f"x{chr(n)}\U00010428 y" for n in [*grows, *range(0xC0, 0x180), *range(0x391, 0x3CA)]] + ["", "ΣΑΣ", "straße ŉ"]
    got = spark.createDataFrame([(w,) for w in words], "x string").select("x", J.uppercase("x").alias("u"), J.uppercase(J.trim("x")).alias("again"), J.lowercase("x").alias("l")).collect()
    simple = lambda x, f: "".join(chr(f(ord(c))) for c in x)
    assert [(r.x, r.u) for r in got] == [(r.x, simple(r.x, letter.toUpperCase)) for r in got]
    assert [(r.x, r.again) for r in got] == [(r.x, r.u) for r in got]
    assert [(r.x, r.l) for r in got] == [(r.x, simple(r.x, letter.toLowerCase)) for r in got]
    assert one(spark, J.uppercase(F.lit(None).cast("string")), J.lowercase(F.lit(1.5))) == ("", "1.5")


def test_dynamic_arguments(spark):
    df = spark.createDataFrame([("hello", 1, "l"), ("hello", -2, "z"), ("hello", -9, ""), (None, 2, "x")], "s string, n int, m string")
    got = df.select(J.substring("s", F.col("n"), 2), J.substring("s", F.col("n")), J.substring_after("s", F.col("m")), J.pad("s", F.col("n") + 6, F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("el", "ello", "lo", "hellol" + "l"), ("lo", "lo", "hello", "hello"), ("he", "hello", "hello", "hello"), ("", "", "", "xxxxxxxx")]


def test_text(spark):
    s = F.lit
    assert one(spark, J.pad(s("x"), 5, "#"), J.pad(s("hello"), 3), J.pad(s(42.0), 5), J.pad(s("a"), 3, ""), J.pad(s("é"), 3, "-")) == ("x####", "hello", "42   ", "a  ", "é-")
    assert one(spark, J.split(s("a,b,c"), ","), J.split(s("abc"), ""), J.split(s(""), ","), J.split(s(",a,b"), ","), J.split(s("a,b,"), ","), J.split(s("a.b"), ".")) == (
        ["a", "b", "c"], ["a", "b", "c"], [""], ["", "a", "b"], ["a", "b", ""], ["a", "b"])
    assert one(spark, J.substring(s("abcdef"), 2), J.substring(s("abcdef"), 1, 2), J.substring(s("abc"), -5, 3), J.substring(s("abc"), -2), J.substring(s("abc"), 9), J.substring(s("abc"), 0, -1)) == ("cdef", "bc", "abc", "bc", "", "")
    assert one(spark, J.substring_before(s("a-b"), "-"), J.substring_before(s("ab"), "-"), J.substring_after(s("a-b-c"), "-"), J.substring_after(s("ab"), "-"), J.contains(s("a.c"), ".")) == ("a", "ab", "b-c", "ab", True)
    assert one(spark, J.trim(s("\t a b  \n")), J.uppercase(s("é")), J.lowercase(s("É")), J.length(s("héé")), J.concat(s("a"), s(None).cast("string"), s(1.0))) == ("a b", "É", "é", 3, "a1")
    assert one(spark, J.join(F.array(s("a"), s(None), s("b"))), J.join(doubles(1, 2.5), "-")) == ("a,,b", "1-2.5")


def test_truth(spark):
    truthy = [F.lit(True), F.lit(1), F.lit("x"), F.array(), F.create_map()]
    falsy = [F.lit(None), F.lit(False), F.lit(0), F.lit(0.0), F.lit(""), F.lit(None).cast("array<int>")]
    assert one(spark, *map(J.truthy, truthy)) == (True,) * len(truthy)
    assert one(spark, *map(J.boolean, falsy)) == (False,) * len(falsy)
    assert one(spark, J.not_(F.lit(0)), J.exists(F.lit(0)), J.exists(F.lit(None))) == (True, True, False)
    assert one(spark, *map(J.type_of, [F.lit(None), F.lit(True), F.lit(1.5), F.lit("a"), F.array(), F.struct(F.lit(1)), F.current_date()])) == ("null", "boolean", "number", "string", "array", "object", "undefined")


def test_arrays(spark):
    assert one(spark, J.number_range(1, 3), J.number_range(3, 1), J.number_range(2, 2)) == ([1, 2, 3], [], [2])
    assert one(spark, J.zip_arrays(doubles(1, 2, 3), doubles(4, 5)), J.zip_arrays(), J.zip_arrays(doubles(1, 2)), J.zip_arrays(doubles(), doubles(1))) == ([[1, 4], [2, 5]], [], [[1], [2]], [])
    assert one(spark, J.append(doubles(1), doubles(2)), J.append(F.lit(1.0), F.lit(2.0), (False, False)), J.distinct(doubles(3, 1, 3, 2, 1)), J.reverse(doubles(1, 2)), J.sort(doubles(10, 9, 1))) == ([1, 2], [1, 2], [3, 1, 2], [2, 1], [1, 9, 10])
    assert sorted(one(spark, J.shuffle(doubles(1, 2, 3)))) == [1, 2, 3]
    assert one(spark, J.contained_in(F.lit(1.0), doubles(1, 2)), J.contained_in(F.lit(3.0), doubles(1)), J.contained_in(F.lit(None).cast("double"), doubles(1)), J.contained_in(F.lit("a"), ["a"])) == (True, False, False, True)
    assert one(spark, J.array_map([1, 2], lambda x: x * 2, lambda x: x + 1), J.filter_array([1, 2], lambda x: x > 1), J.reduce_array([1, 2], F.lit(0.0), lambda a, x: a + x)) == ([3, 5], [2], 3)


def test_objects(spark):
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    none = F.lit(None).cast("map<string,string>")
    assert one(spark, J.keys(m), J.values(m), J.keys(none), J.merge(m, F.create_map(F.lit("a"), F.lit("3")), none), J.merge(none, m)["b"], J.spread(m)["a"]) == (["a", "b"], ["2", "1"], None, {"b": "1", "a": "3"}, "1", "2")
    kind = T.StructType.fromDDL("b string, a string")
    assert one(spark, J.wildcard(F.struct(F.lit("x").alias("b"), F.lit("y").alias("a")), kind)) == ["y", "x"]
    assert one(spark, J.each_value(m, lambda v, k: F.concat(k, v)), J.filter_object(m, lambda v, k: k == "a")) == (["a2", "b1"], {"a": "2"})


def test_paths(spark):
    d = parse(F.lit('{"a":{"b":{"c":99}}}'))
    assert one(spark, J.extract(d, "a.b.c", "int"), J.lookup(d, "a.b.c", "int"), J.lookup(d, "a.x.c"), J.lookup(parse(F.lit("bad")), "a")) == (99, 99, None, None)
    assert one(spark, J.extract(parse(F.lit("null")), "a.b"), J.extract(parse(F.lit(None).cast("string")), "a")) == (None, None)
    for path in ("x", "a.x", "a.b.c.d"):
        with pytest.raises(Exception, match="no path"):
            one(spark, J.extract(d, path))


def test_times(spark):
    s = F.lit
    assert one(spark, J.to_millis(s("2024-01-15T10:30:00.123456789Z")), J.to_millis(s("2024-01-15T10:30:00Z")), J.to_millis(s("no")), J.to_millis(s("2024-01-15"))) == (1705314600123, 1705314600000, 0, 0)
    assert one(spark, J.from_millis(s(1705315800123)), J.from_millis(s(1705315800120)), J.from_millis(s(1705315800000))) == ("2024-01-15T10:50:00.123Z", "2024-01-15T10:50:00.12Z", "2024-01-15T10:50:00Z")
    assert one(spark, J.now()).endswith("Z") and one(spark, J.millis()) > 1.6e12


def test_combinations(spark):
    double = lambda x: J.multiply(x, 2)
    assert one(spark, J.chain(F.lit(5), double, double), J.compose(double, J.string)(F.lit(5)), J.chain(F.lit("abcd"), J.partial(J.substring, HOLE, 1, 2))) == (20, "10", "bc")


def test_zip_keeps_all_tuples(spark):
    assert one(spark, J.zip_arrays(doubles(1, 2, 3, 4, 5), doubles(6, 7, 8, 9, 10))) == [[1, 6], [2, 7], [3, 8], [4, 9], [5, 10]]
