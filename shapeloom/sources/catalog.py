"""Named sources: a provider has a base address and endpoints; each endpoint is read as a DataFrame."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, urlencode, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TIMEOUT_MS, MOST_TIMEOUT_MS = 10_000, 300_000


class ConfigError(ValueError):
    """A provider that can't be used as it is configured."""


@dataclass(frozen=True)
class Endpoint:
    path: str
    timeout_ms: int | None = None
    use_cache: bool = False

    @classmethod
    def of(cls, value: str | Mapping[str, Any]) -> Endpoint:
        if isinstance(value, str):
            return cls(value)
        return cls(value.get("path", ""), value.get("timeout"), bool(value.get("use_cache", False)))


@dataclass(frozen=True)
class Provider:
    base_url: str
    endpoints: Mapping[str, Endpoint]
    format: str = "parquet"  #: parquet, json or http_json
    headers: Mapping[str, str] = field(default_factory=dict)
    query: Mapping[str, str] = field(default_factory=dict)
    timeout_ms: int | None = None
    connection_timeout_ms: int | None = None
    redirections_max: int = 10
    optional: bool = False

    @classmethod
    def of(cls, config: Mapping[str, Any]) -> Provider:
        """From a configuration: base_url, or host and path; endpoints by name, each a path or its settings."""
        base = config.get("base_url") or (config.get("host") or "").rstrip("/") + (config.get("path") or "")
        provider = cls(
            base, {k: Endpoint.of(v) for k, v in (config.get("endpoints") or {}).items()}, config.get("format", "http_json" if base.startswith("http") else "parquet"),
            config.get("headers") or {}, config.get("query") or {}, config.get("timeout"), config.get("connection_timeout"), config.get("redirections_max", 10), bool(config.get("optional", False)),
        )
        provider.validate()
        return provider

    def validate(self) -> None:
        parts = urlsplit(self.base_url)
        if not parts.scheme or not (parts.netloc or parts.scheme == "file"):
            raise ConfigError("the address needs a scheme and a host")
        for ms in (self.timeout_ms, self.connection_timeout_ms, *(e.timeout_ms for e in self.endpoints.values())):
            if ms is not None and not 1 <= ms <= MOST_TIMEOUT_MS:
                raise ConfigError(f"a timeout is 1 to {MOST_TIMEOUT_MS} ms")
        if not self.endpoints:
            raise ConfigError("a provider has at least one endpoint")
        if any(not e.path.strip() for e in self.endpoints.values()):
            raise ConfigError("an endpoint's path is empty")
        if self.redirections_max < 0:
            raise ConfigError("redirections can't be fewer than none")

    def url(self, endpoint: str, params: Mapping[str, Any] | None = None) -> str:
        """``{name}`` in the path is filled from the params; one that lacks is an error."""

        def fill(m: re.Match) -> str:
            if params is None or m[1] not in params:
                raise KeyError(f"no parameter {m[1]} for {endpoint}")
            return quote(str(params[m[1]]), safe="")

        path = re.sub(r"\{(\w+)\}", fill, self.endpoints[endpoint].path)
        url = self.base_url.rstrip("/") + "/" + path.lstrip("/")
        return url + ("&" if "?" in url else "?") + urlencode(self.query) if self.query else url

    def url_column(self, endpoint: str, params: Mapping[str, Column] | None = None) -> Column:
        """The url of each row; NULL where a parameter is."""
        parts, at, path = [F.lit(self.base_url.rstrip("/") + "/")], 0, self.endpoints[endpoint].path.lstrip("/")
        for m in re.finditer(r"\{(\w+)\}", path):
            value = (params or {}).get(m[1], F.lit(None)).cast("string")
            # in a path a blank is %20
            parts += [F.lit(path[at : m.start()]), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))]
            at = m.end()
        tail = path[at:]
        if self.query:
            tail += ("&" if "?" in path else "?") + urlencode(self.query)
        return F.concat(*parts, F.lit(tail))

    def options(self, endpoint: str) -> dict[str, str]:
        """Of a call over HTTP."""
        o = {"timeout_ms": self.timeout(endpoint), "redirections_max": self.redirections_max, "optional": str(self.optional).lower()}
        return {k: str(v) for k, v in (o if self.connection_timeout_ms is None else o | {"connection_timeout_ms": self.connection_timeout_ms}).items()}

    def timeout(self, endpoint: str) -> int:
        return self.endpoints[endpoint].timeout_ms or self.timeout_ms or DEFAULT_TIMEOUT_MS


class Catalog:
    """Providers by name.  The same read in one catalog is the same DataFrame, so plans share its scan; the answers of an
    endpoint with ``use_cache`` are kept, too, until ``close``: a call is sent once, however often its answer is used."""

    def __init__(self, spark: SparkSession, providers: Mapping[str, Provider]) -> None:
        self.spark, self.providers = spark, dict(providers)
        self._read: dict[tuple, DataFrame] = {}
        self._answers: list[DataFrame] = []

    def fetch(self, provider: str, endpoint: str, params: Mapping[str, Any] | None = None, method: str = "GET", headers: Mapping[str, str] | None = None, body: Any = None, schema: T.StructType | str | None = None) -> DataFrame:
        """The endpoint's records: a table, or for http_json a row per answer with its body as text.

        An optional provider that can't be read, or whose url lacks a parameter, gives one row of nulls (with a schema),
        or one null body.
        """
        p = self.providers[provider]
        if endpoint not in p.endpoints:
            raise KeyError(f"{provider} has no endpoint {endpoint}")
        try:
            url = p.url(endpoint, params)
        except KeyError:
            if not p.optional:
                raise
            return self._nothing("url string, status int, body string" if p.format == "http_json" else schema)
        sent = json.dumps({**p.headers, **(headers or {})}, sort_keys=True)
        key = (provider, url, method.upper(), sent, json.dumps(body, sort_keys=True), str(schema))
        if key not in self._read:
            self._read[key] = self._load(p, endpoint, url, method.upper(), sent, body, schema)
        return self._read[key]

    def _load(self, p: Provider, endpoint: str, url: str, method: str, headers: str, body: Any, schema: T.StructType | str | None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None and p.format != "http_json" else self.spark.read
        if p.format == "http_json":
            from .http import register

            register(self.spark)
            options = {"url": url, "method": method, "headers": headers, **p.options(endpoint)}
            answer = reader.format("http_json").options(**options, **({} if body is None else {"body": json.dumps(body)})).load()
            return self._kept(answer) if p.endpoints[endpoint].use_cache else answer
        try:
            return reader.format(p.format).load(url)
        except AnalysisException:
            if not p.optional:
                raise
            return self._nothing(schema)

    def _nothing(self, schema: T.StructType | str | None) -> DataFrame:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or T.StructType([T.StructField("body", T.StringType())])
        return self.spark.createDataFrame([tuple(None for _ in kind.fields)], T.StructType([T.StructField(f.name, f.dataType, True) for f in kind.fields]))

    def _kept(self, answers: DataFrame) -> DataFrame:
        self._answers.append(answers.persist())
        return self._answers[-1]

    def close(self) -> None:
        """Forget all answers."""
        while self._answers:
            self._answers.pop().unpersist()
        self._read.clear()

    def fetch_each(
        self, requests: DataFrame, provider: str, endpoint: str, params: Mapping[str, Column] | None = None, method: str = "GET", headers: Mapping[str, Column] | None = None, body: Column | None = None, name: str = "answer"
    ) -> DataFrame:
        """``requests`` with a struct (status, body) of the answer to each, by HTTP: params, headers and body are columns.

        With ``use_cache`` equal calls are sent once.  A row whose url lacks a parameter has no answer if the provider is
        optional; otherwise it fails the query.  Null headers aren't sent.  Calls are made where the rows are, one after the
        other in a task: as many at a time as there are tasks.
        """
        from .http import fetch_each

        p = self.providers[provider]
        if endpoint not in p.endpoints:
            raise KeyError(f"{provider} has no endpoint {endpoint}")
        url = p.url_column(endpoint, params)
        url = url if p.optional else F.coalesce(url, F.raise_error(F.lit(f"a parameter for {endpoint} is missing")).cast("string"))
        sent = F.create_map(*(x for k, v in {**{k: F.lit(v) for k, v in p.headers.items()}, **(headers or {})}.items() for x in (F.lit(k), v.cast("string")))) if p.headers or headers else F.create_map().cast("map<string,string>")
        text = F.lit(None).cast("string") if body is None else body.cast("string")
        rows = requests.withColumn("__call", F.struct(url.alias("url"), F.map_filter(sent, lambda k, v: v.isNotNull()).alias("headers"), text.alias("body")))
        if not p.endpoints[endpoint].use_cache:
            return fetch_each(rows, p.options(endpoint), method.upper(), name)
        parts = F.struct("__call.url", F.array_sort(F.map_entries("__call.headers")), "__call.body")
        rows = rows.select(*requests.columns, F.unhex(F.sha2(F.to_json(parts).cast("binary"), 256)).alias("__key"), "__call")
        calls = rows.select("__key", "__call").dropDuplicates(["__key"])
        answers = self._kept(fetch_each(calls, p.options(endpoint), method.upper(), name))
        return rows.join(answers, "__key", "left").drop("__key", "__call")

    def check(self) -> dict[str, str]:
        """What can't be read of each provider; healthy ones aren't in it."""
        out = {}
        for name, p in self.providers.items():
            for endpoint in p.endpoints:
                try:
                    self.fetch(name, endpoint).limit(1).collect()
                except Exception as e:  # whatever stands in the way
                    out[f"{name}.{endpoint}"] = str(e).split("\n")[0][:200]
        return out
