"""Filters.

A missing number counts as 0.  ``coalesce(x, 0) < 100`` would say so but can't be pushed into a Parquet scan;
``x < 100 OR x IS NULL`` can, and is needed only where 0 itself passes the test.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import truthy

_TESTS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def number_test(column: Column | str, test: str, value: float) -> Column:
    """``column test value`` with a missing number as 0, in a form that scans can use."""
    column = F.col(column) if isinstance(column, str) else column
    holds = _TESTS[test](column, F.lit(float(value)))
    return holds | column.isNull() if _TESTS[test](0.0, value) else holds


def where_numbers(df: DataFrame, *tests: tuple[str, str, float]) -> DataFrame:
    """Rows that pass all of the (column, test, number)."""
    for column, test, value in tests:
        df = df.where(number_test(column, test, value))
    return df


def where_all(df: DataFrame, *predicates: Column | str) -> DataFrame:
    """Rows for which all predicates are truthy; a name is a column, whatever its type, tested in a form that scans can use."""
    types = dict(df.dtypes)
    for p in predicates:
        df = df.where(p if isinstance(p, Column) else _truthy(p, types.get(p, "")))
    return df


def _truthy(name: str, kind: str) -> Column:
    x = F.col(name)
    if kind == "boolean":
        return x
    if kind == "string":
        return x.isNotNull() & (x != "")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return x.isNotNull() & (x != 0)
    return truthy(name)


def element_at(df: DataFrame, index: int, order: Sequence[Column | str], *predicates: Column) -> DataFrame:
    """The row at a 0-based index of *all* rows in their order, if it passes the predicates.

    Only ``index + 1`` rows of each partition are looked at; rows have no order of their own, so the keys must
    give one.
    """
    if index < 0:
        raise ValueError("an index is not negative")
    row = df.orderBy(*order).offset(index).limit(1)
    for p in predicates:
        row = row.where(p)
    return row
