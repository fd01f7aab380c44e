"""Aggregates over the children of records.

Children that lie in a table of their own are grouped before the join: partial sums shrink them in front of
the shuffle, and the records themselves are never nested.  ``nest`` is for functions that need the array.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGGREGATES = {"sum": F.sum, "count": lambda c: F.count(F.lit(1)), "min": F.min, "max": F.max, "average": F.avg}


def aggregate_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, fields: Mapping[str, tuple[str, Column | str]]) -> DataFrame:
    """``parents`` with a field per (aggregate, number): sum, count, min, max or average, 0 without children."""
    made = []
    for name, (kind, value) in fields.items():
        number = F.coalesce((F.col(value) if isinstance(value, str) else value).cast("double"), F.lit(0.0))
        made.append(_AGGREGATES[kind](number).cast("double").alias(name))
    grouped = children.groupBy(F.col(child_key).alias("__key")).agg(*made)
    joined = parents.join(grouped, F.col(parent_key) == F.col("__key"), "left").drop("__key")
    # not fillna, which would also replace NaN
    return joined.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in fields})


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str, order: str) -> DataFrame:
    """``parents`` with the array of their children, sorted by ``order``, which comes first in each; for
    children that are few for each parent."""
    columns = [order, *(c for c in children.columns if c not in (order, child_key))]
    grouped = children.groupBy(F.col(child_key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(grouped, F.col(parent_key) == F.col("__key"), "left").drop("__key")
