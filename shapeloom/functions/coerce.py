"""Conversions between JSON types.

``typeof`` is constant for a column, so Catalyst folds the branches for other types away.  Until then the plan has them all,
so what is known to be text is marked and passed through as it is: nested text functions don't multiply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int | bool | None
_FRACTIONS = ("double", "float")
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def col(x: ColumnLike) -> Column:
    """A name is a column, another Python value a literal; numbers are doubles."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else F.lit(x)


def _is(x: Column, *types: str) -> Column:
    return F.typeof(x).isin(*types)


def _numeric(x: Column) -> Column:
    return _is(x, *_FRACTIONS, *_WHOLE) | F.typeof(x).startswith("decimal")


def as_text(x: Column) -> Column:
    """Marks a column that is text and never NULL."""
    x._is_text = True
    return x


def is_text(x: ColumnLike) -> bool:
    return isinstance(x, Column) and x.__dict__.get("_is_text", False)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x in the plan once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _number_text(s: Column) -> Column:
    """Of a double as Spark writes it: all digits from 1e-6 up to 1e21, else an exponent with a sign and two digits."""
    digits = F.when(s.rlike("E-[456]$"), s.try_cast("decimal(38,26)").cast("string")).when(s.rlike("E([7-9]|1[0-9]|20)$"), s.try_cast("decimal(38,12)").cast("string")).when(~s.contains("E"), s)
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), r"\.0e", "e"), "e([0-9])", "e+$1"), "e([+-])([0-9])$", "e$10$2")
    short = F.regexp_replace(F.regexp_replace(F.coalesce(digits, exponent), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")  # zeros behind the point
    return F.regexp_replace(short, "^-0$", "0")


def string(x: ColumnLike) -> Column:
    """Text as it is, "" for nothing; numbers as JSON writes them: all digits from 1e-6 up to 1e21, else 1e-07, 1e+21.

    As many digits as the JVM gives a double.
    """
    x = col(x)
    if is_text(x):
        return x
    s = x.cast("string")
    return as_text(F.coalesce(F.when(_is(x, *_FRACTIONS), _number_text(s)).otherwise(s), F.lit("")))


def number(x: ColumnLike) -> Column:
    """Numbers as doubles; text that is a number, without blanks around it, or 0; true is 1; all else 0."""
    x = col(x)
    s = x.cast("string")
    text = F.when(s.rlike(r"^[^\s]+$") & ~s.rlike("[dDfF]$"), s.try_cast("double"))
    return F.coalesce(F.when(_is(x, "boolean"), (s == "true").cast("double")).when(_numeric(x), s.try_cast("double")).when(_is(x, "string"), text), F.lit(0.0))


def truthy(x: ColumnLike) -> Column:
    """False for nothing, false, 0 and ""; all else is true, also empty arrays and objects."""
    x = col(x)
    s = x.cast("string")
    told = F.when(_is(x, "boolean"), s == "true").when(_numeric(x), s.try_cast("double") != 0).when(_is(x, "string"), s != "").otherwise(x.isNotNull())
    return F.coalesce(told, F.lit(False))


def boolean(x: ColumnLike) -> Column:
    return truthy(x)


def not_(x: ColumnLike) -> Column:
    return ~truthy(x)


def exists(x: ColumnLike) -> Column:
    """Whether there is a value; JSON's null is none."""
    return col(x).isNotNull()


def type_of(x: ColumnLike) -> Column:
    """null, boolean, number, string, array, object, or undefined for what JSON hasn't."""
    x = col(x)
    t = F.typeof(x)
    return (
        F.when(x.isNull(), "null").when(_is(x, "boolean"), "boolean").when(_numeric(x), "number").when(_is(x, "string"), "string")
        .when(t.startswith("array"), "array").when(t.startswith("struct") | t.startswith("map"), "object").otherwise("undefined")
    )
