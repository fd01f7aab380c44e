"""Array functions.

Aggregates take the array of one field (``items.price``), not the array of objects: only then does the
Parquet scan read that field alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import ColumnLike, col


def _numbers(items: ColumnLike) -> Column:
    """Doubles, nothing as 0, no array as an empty one."""
    return F.coalesce(F.transform(col(items), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array().cast("array<double>"))


def _list(x: Column | list) -> Column:
    """A Python list is an array of literals; numbers are doubles."""
    return literal_array(*x) if isinstance(x, list) else col(x)


def literal_array(*items: ColumnLike) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else col(x) for x in items))


def sum_of(items: ColumnLike) -> Column:
    return F.aggregate(_numbers(items), F.lit(0.0), lambda total, x: total + x)


def count_of(items: ColumnLike) -> Column:
    return F.greatest(F.coalesce(F.size(col(items)), F.lit(0)), F.lit(0)).cast("double")


def min_of(items: ColumnLike) -> Column:
    """0 of none."""
    return F.coalesce(F.array_min(_numbers(items)), F.lit(0.0))


def max_of(items: ColumnLike) -> Column:
    """0 of none."""
    return F.coalesce(F.array_max(_numbers(items)), F.lit(0.0))


def average_of(items: ColumnLike) -> Column:
    """0 of none."""
    return F.coalesce(F.try_divide(sum_of(items), count_of(items)), F.lit(0.0))


def number_range(first: Column | int, last: Column | int) -> Column:
    """Whole numbers from first to last as doubles; none if first is larger."""
    first, last = (x.cast("long") if isinstance(x, Column) else F.lit(int(x)).cast("long") for x in (first, last))
    # sequence counts down if it must
    return F.when(first > last, F.array().cast("array<double>")).otherwise(F.sequence(first, F.greatest(first, last)).cast("array<double>"))


def array_map(items: Column | list, *steps: Callable[[Column], Column]) -> Column:
    """Each step maps what the one before has made."""
    out = _list(items)
    for step in steps:
        out = F.transform(out, step)
    return out


def filter_array(items: Column | list, keep: Callable[[Column], Column]) -> Column:
    return F.filter(_list(items), keep)


def reduce_array(items: Column | list, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(_list(items), start, step)


def contained_in(x: ColumnLike, items: Column | list) -> Column:
    """Membership; nothing is in no array of values.  Of a list in a form that scans can use."""
    if isinstance(items, list):
        x, there = col(x), [i for i in items if i is not None]
        return x.isNull() | x.isin(there) if None in items else x.isNotNull() & x.isin(there)
    return F.coalesce(F.array_contains(items, col(x)), F.lit(False))


def _wrapped(x: Column | list, is_array: bool) -> Column:
    return _list(x) if is_array or isinstance(x, list) else F.array(col(x))


def append(a: Column | list, b: Column | list, arrays: tuple[bool, bool] = (True, True)) -> Column:
    """One after the other.  ``arrays`` tells which side is an array; the other becomes one of one element."""
    return F.concat(_wrapped(a, arrays[0]), _wrapped(b, arrays[1]))


def distinct(items: Column | list) -> Column:
    """The first of equal elements stays in its place."""
    return F.array_distinct(_list(items))


def reverse(items: Column | list) -> Column:
    return F.reverse(_list(items))


def sort(items: Column | list) -> Column:
    """Ascending, nothing last."""
    return F.array_sort(_list(items))


def shuffle(items: Column | list) -> Column:
    return F.shuffle(_list(items))


def zip_arrays(*arrays: Column | list) -> Column:
    """Tuples, as arrays, as many as the shortest array has elements; the arrays have one element type."""
    if not arrays:
        return F.array().cast("array<array<string>>")
    lists = [_list(a) for a in arrays]
    least = F.size(lists[0]) if len(lists) == 1 else F.least(*map(F.size, lists))
    tuples = F.when(least > 0, F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda k: F.array(*(F.try_element_at(x, k) for x in lists))))
    return F.coalesce(tuples, F.slice(F.array(F.array(*(F.try_element_at(x, F.lit(1)) for x in lists))), 1, 0))
