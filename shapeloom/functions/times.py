"""Instants: milliseconds since 1970 as doubles, or RFC 3339 text in UTC.  The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import ColumnLike, col

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _iso(ts: Column, fraction: str) -> Column:
    return F.regexp_replace(F.date_format(ts, f"yyyy-MM-dd'T'HH:mm:ss.{fraction}'Z'"), r"\.?0*Z$", "Z")


def now() -> Column:
    """One instant for the whole query."""
    return _iso(F.current_timestamp(), "SSSSSS")


def millis() -> Column:
    return F.unix_millis(F.current_timestamp()).cast("double")


def from_millis(x: ColumnLike) -> Column:
    """Without trailing zeros of the fraction."""
    return _iso(F.timestamp_millis(col(x).cast("long")), "SSS")


def to_millis(x: ColumnLike) -> Column:
    """0 for what isn't RFC 3339."""
    s = col(x)
    return F.coalesce(F.when(s.rlike(_RFC3339), F.unix_millis(F.try_to_timestamp(s))).cast("double"), F.lit(0.0))
