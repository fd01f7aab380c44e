"""Data source ``http_json``: one row per url with the answer's body.

Options: url (several by line), method, headers (JSON), body, timeout_ms, connection_timeout_ms, redirections_max,
max_bytes, optional.  Urls are partitions, so they are fetched in parallel.  A status of 400 and above, and a body beyond
``max_bytes``, fail the read, or give a null body if the source is optional.  Spark repeats failed tasks, so a
method that isn't idempotent should be used with ``spark.task.maxFailures=1`` and without speculation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES = 10 << 20


def call(url: str, o: Mapping[str, str], method: str = "GET", headers: Mapping[str, str] | None = None, body: str | None = None) -> tuple[int | None, str | None]:
    """Status and body of one answer; (None, None) if it fails and the source is optional."""
    import http.client
    import urllib.error
    import urllib.request

    most, wait = int(o.get("max_bytes", MAX_BYTES)), float(o.get("timeout_ms", 10_000)) / 1000
    to_connect = min(wait, float(o.get("connection_timeout_ms") or 1000 * wait) / 1000)

    def connection(kind: type) -> type:
        class Patient(kind):
            def connect(self) -> None:
                self.timeout = to_connect
                super().connect()
                self.sock.settimeout(wait)

        return Patient

    class Http(urllib.request.HTTPHandler):
        def http_open(self, request):
            return self.do_open(connection(http.client.HTTPConnection), request)

    class Https(urllib.request.HTTPSHandler):
        def https_open(self, request):
            return self.do_open(connection(http.client.HTTPSConnection), request)

    class Redirects(urllib.request.HTTPRedirectHandler):
        max_redirections = int(o.get("redirections_max", 10))

    request = urllib.request.Request(url, None if body is None else body.encode(), dict(headers or {}), method=method)
    try:
        with urllib.request.build_opener(Http, Https, Redirects).open(request, timeout=wait) as answer:
            data = answer.read(most + 1)
            if len(data) > most:
                raise ValueError(f"{url}: the body has more than {most} bytes")
            return answer.status, data.decode()
    except (OSError, ValueError, http.client.HTTPException):
        if o.get("optional") != "true":
            raise
        return None, None


class UrlPartition(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class HttpJsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [UrlPartition(u) for u in self.options["url"].split("\n") if u.strip()]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        o = self.options
        yield partition.url, *call(partition.url, o, o.get("method", "GET"), json.loads(o.get("headers", "{}")), o.get("body"))


class HttpJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return HttpJsonReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpJson)


_ANSWER = pa.struct([("status", pa.int32()), ("body", pa.string())])


def fetch_each(rows: DataFrame, options: Mapping[str, str], method: str, name: str) -> DataFrame:
    """``rows``, whose last column is a struct (url, headers, body), with a struct (status, body) of its answer in that
    column's place; a null url isn't called.  Answers go out one by one: none is held for another."""
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.StructType.fromDDL("status int, body string"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                sent = row.columns[-1][0].as_py()
                status, body = (None, None) if sent["url"] is None else call(sent["url"], options, method, dict(sent["headers"] or ()), sent["body"])
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([{"status": status, "body": body}], _ANSWER)], names=schema.names)

    return rows.mapInArrow(run, schema)
