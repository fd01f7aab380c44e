"""Projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def project(df: DataFrame, fields: Mapping[str, Column | str], bindings: Mapping[str, Column | str] | None = None) -> DataFrame:
    """One output row per input row, with the fields in their order.

    ``bindings`` are named values that later bindings and the fields can use; a name is bound once.
    """
    for name, value in (bindings or {}).items():
        if name in df.columns:
            raise ValueError(f"{name} is taken")
        df = df.withColumn(name, _column(value))
    return df.select(*(_column(v).alias(k) for k, v in fields.items()))


def root(spark: SparkSession, fields: Mapping[str, Column]) -> DataFrame:
    """One row of expressions that need no source."""
    return spark.range(1).select(*(v.alias(k) for k, v in fields.items()))


def range_rows(spark: SparkSession, first: int, last: int, name: str = "value") -> DataFrame:
    """A row per whole number from first to last, as a double; none if first is larger."""
    return spark.range(first, max(first, last + 1)).select(F.col("id").cast("double").alias(name))
