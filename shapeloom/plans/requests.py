"""A batch of requests is a DataFrame; what a request holds is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objects import lookup

SCHEMA = """request_id long, headers map<string,string>, cookies map<string,string>, query map<string,string>,
            params map<string,string>, path string, method string, body string"""


def header(name: str) -> Column:
    return F.col("headers")[name]


def cookie(name: str) -> Column:
    return F.col("cookies")[name]


def query(name: str) -> Column:
    return F.col("query")[name]


def param(name: str) -> Column:
    return F.col("params")[name]


def body_field(path: str, kind: str = "string") -> Column:
    return lookup(F.try_parse_json("body"), path, kind)


def look_up(requests: DataFrame, table: DataFrame, key: Column, table_key: str) -> DataFrame:
    """Each request with its row of ``table``, or nulls: the batch form of a path like ``/posts/{id}``."""
    return requests.withColumn("__key", key).join(table, F.col("__key") == F.col(table_key).cast("string"), "left").drop("__key")


def assemble(requests: DataFrame, **sources: DataFrame) -> DataFrame:
    """``requests`` with one struct field per source; a source has a row per request_id, or none: then null."""
    out = requests
    for name, df in sources.items():
        fields = [c for c in df.columns if c != "request_id"]
        out = out.join(df.select("request_id", F.struct(*fields).alias(name)), "request_id", "left")
    return out
