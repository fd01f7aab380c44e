"""Request validation: rules are boolean columns, the first that is broken is the answer."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for values that break it."""

    broken: Column
    message: str


def _given(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("")) != ""


def required(x: Column, name: str) -> Rule:
    return Rule(~_given(x), f"{name} is required")


def of_type(x: Column, name: str, kind: str) -> Rule:
    spark_type = {"integer": "bigint", "number": "double", "boolean": "boolean"}[kind]
    shape = {"integer": r"^[+-]?[0-9]+$", "number": r"^\S+$", "boolean": r"^\S+$"}[kind]
    return Rule(_given(x) & (x.try_cast(spark_type).isNull() | ~x.rlike(shape)), f"{name} is not of type {kind}")


def constraints(x: Column, name: str, schema: Mapping[str, Any]) -> list[Rule]:
    """Rules of one field's schema: type, minLength, maxLength (bytes), pattern, enum, format email, minimum, maximum."""
    rules = []
    kind = schema.get("type")
    if kind in ("integer", "number", "boolean"):
        rules.append(of_type(x, name, kind))
    n = x.try_cast("double")
    tests = {
        "minLength": lambda v: F.octet_length(x) < v, "maxLength": lambda v: F.octet_length(x) > v, "pattern": lambda v: ~x.rlike(v),
        "enum": lambda v: ~x.isin([str(e) for e in v]), "minimum": lambda v: n < v, "maximum": lambda v: n > v,
    }
    for key, broken in tests.items():
        if key in schema:
            rules.append(Rule(_given(x) & broken(schema[key]), f"{name} breaks {key} {schema[key]}"))
    if schema.get("format") == "email":
        rules.append(Rule(_given(x) & ~F.contains(x, F.lit("@")), f"{name} is not an email"))
    return rules


def body_rules(body: Column, schema: Mapping[str, Any], is_required: bool = True) -> list[Rule]:
    """A body that must be there, be an object, and have the required top-level keys."""
    rules = [required(body, "body")] if is_required else []
    parsed = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    rules.append(Rule(_given(body) & ~is_object, "body is not an object"))
    for key in schema.get("required", ()):
        rules.append(Rule(_given(body) & ~F.coalesce(F.array_contains(F.json_object_keys(body), key), F.lit(False)), f"body.{key} is required"))
    return rules


def resolve(schema: Mapping[str, Any], components: Mapping[str, Any]) -> Mapping[str, Any]:
    """The schema that a ``#/components/schemas/`` reference names."""
    seen: set[str] = set()
    while "$ref" in schema:
        name = schema["$ref"].rpartition("/")[2]
        if name in seen or name not in components:
            raise ValueError(f"reference to {name} leads nowhere")
        seen.add(name)
        schema = components[name]
    return schema


def first_failure(rules: list[Rule]) -> Column:
    """Message of the first broken rule; NULL if none is."""
    out = None
    for r in rules:
        out = F.when(r.broken, r.message) if out is None else out.when(r.broken, r.message)
    return F.lit(None).cast("string") if out is None else out


def validate(requests: DataFrame, rules: list[Rule], column: str = "error") -> DataFrame:
    """``requests`` with an error struct (error, status, code), or NULL."""
    message = first_failure(rules)
    return requests.withColumn(column, F.when(message.isNotNull(), F.struct(message.alias("error"), F.lit(400).alias("status"), F.lit("VALIDATION_ERROR").alias("code"))))


def operation_rules(operation: Mapping[str, Any], components: Mapping[str, Any] | None = None) -> list[Rule]:
    """Rules of an OpenAPI operation over a requests DataFrame: its header, query, path and cookie parameters in
    their order, then its JSON body."""
    components = components or {}
    columns = {"header": "headers", "query": "query", "path": "params", "cookie": "cookies"}
    rules = []
    for p in operation.get("parameters", ()):
        x, name = F.col(columns[p["in"]])[p["name"]], f"{p['in']} {p['name']}"
        if p.get("required"):
            rules.append(required(x, name))
        rules += constraints(x, name, resolve(p.get("schema", {}), components))
    if request_body := operation.get("requestBody"):
        content = request_body.get("content", {}).get("application/json", {})
        rules += body_rules(F.col("body"), resolve(content.get("schema", {}), components), bool(request_body.get("required")))
    return rules
