"""Responses: a struct (status, headers, body) per request; bodies are JSON text with their nulls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import code_of_status

_JSON = {"ignoreNullFields": "false"}


def body(value: Column) -> Column:
    return F.to_json(value, _JSON)


def _headers(headers: Mapping[str, str] | None) -> Column:
    all_ = {"Content-Type": "application/json", **(headers or {})}
    return F.create_map(*(F.lit(x) for kv in all_.items() for x in kv))


def http_response(status: int, value: Column, headers: Mapping[str, str] | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), _headers(headers).alias("headers"), body(value).alias("body"))


def http_error(status: int, message: str, code: str | None = None) -> Column:
    """Of the same type as a response; its body has error, status and code, which follows from the status if
    none is given."""
    if not 400 <= status <= 599:
        raise ValueError("an error's status is 400 to 599")
    return http_response(status, F.struct(F.lit(message).alias("error"), F.lit(status).alias("status"), F.lit(code or code_of_status(status)).alias("code")))


def fail(message: Column | str) -> Column:
    """Ends the whole query when a row comes to it."""
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def collect_body(items: DataFrame, by: str, order: str, unwrap: bool = False) -> DataFrame:
    """One body per request: the JSON array of its items in order; with ``unwrap`` one item stands alone.

    A request's items are its answer, so they are together in one row; a request without items has none here.
    """
    fields = [c for c in items.columns if c not in (by, order)]
    listed = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("item")))).alias("__items"))
    array = F.transform("__items", lambda x: x["item"])
    whole = body(array)
    out = F.when(F.size("__items") == 1, body(F.element_at(array, 1))).otherwise(whole) if unwrap else whole
    return listed.select(by, out.alias("body"))
