"""Arithmetic on doubles; nothing is 0.  Divisions never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import ColumnLike, col


def _number(x: ColumnLike) -> Column:
    return F.coalesce(col(x).cast("double"), F.lit(0.0))


def add(a: ColumnLike, b: ColumnLike) -> Column:
    return _number(a) + _number(b)


def subtract(a: ColumnLike, b: ColumnLike) -> Column:
    return _number(a) - _number(b)


def multiply(a: ColumnLike, b: ColumnLike) -> Column:
    return _number(a) * _number(b)


def divide(a: ColumnLike, b: ColumnLike) -> Column:
    """As IEEE has it: by 0 to infinity, 0 / 0 to NaN."""
    a, b = _number(a), _number(b)
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def modulo(a: ColumnLike, b: ColumnLike) -> Column:
    """With the sign of the dividend, but never -0; NULL by 0."""
    return F.try_mod(_number(a), _number(b)) + 0.0


def negate(x: ColumnLike) -> Column:
    return -_number(x)


def abs_(x: ColumnLike) -> Column:
    return F.abs(_number(x))


def floor(x: ColumnLike) -> Column:
    return F.floor(_number(x)).cast("double")


def ceil(x: ColumnLike) -> Column:
    return F.ceil(_number(x)).cast("double")


def round_(x: ColumnLike, digits: int = 0) -> Column:
    """Halves away from zero, after scaling by a power of ten."""
    if not digits:
        return F.round(_number(x))
    scale = F.lit(10.0**digits)
    return F.round(_number(x) * scale) / scale


def power(x: ColumnLike, exponent: ColumnLike) -> Column:
    return F.pow(_number(x), _number(exponent))


def sqrt(x: ColumnLike) -> Column:
    """NaN of negative numbers."""
    return F.sqrt(_number(x))


def random(seed: int | None = None) -> Column:
    return F.rand(seed)
