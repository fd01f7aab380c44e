"""Objects: maps (keys known to the data), structs (keys known to the plan) and VARIANT (keys known to nobody)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import ColumnLike, col


def keys(x: ColumnLike) -> Column:
    """Sorted keys of a map; nothing of nothing."""
    return F.array_sort(F.map_keys(col(x)))


def json_keys(x: ColumnLike) -> Column:
    """Sorted keys of an object in JSON text; NULL of anything else."""
    return F.array_sort(F.json_object_keys(col(x)))


def values(x: ColumnLike, kind: T.StructType | None = None) -> Column:
    """Values in the order of their sorted keys: of a map, or, with its type, of a struct."""
    x = col(x)
    if kind is not None:
        return F.when(x.isNotNull(), F.array(*(x[name] for name in sorted(kind.fieldNames()))))
    return F.transform(keys(x), lambda k: x[k])


def wildcard(x: ColumnLike, kind: T.StructType | None = None) -> Column:
    return values(x, kind)


def each_value(x: ColumnLike, f: Callable[[Column, Column], Column]) -> Column:
    """f(value, key) of each entry, in the order of the keys."""
    x = col(x)
    return F.transform(keys(x), lambda k: f(x[k], k))


def filter_object(x: ColumnLike, keep: Callable[[Column, Column], Column]) -> Column:
    """The entries for which keep(value, key) holds."""
    return F.map_filter(col(x), lambda k, v: keep(v, k))


def merge(*maps: ColumnLike) -> Column:
    """Of equal keys the last map's value holds; what isn't there is passed over."""
    def without(x: Column, m: Column) -> Column:
        return F.map_filter(x, lambda k, v: ~F.map_contains_key(m, k))

    first, *rest = map(col, maps)
    out = F.coalesce(first, without(rest[0], rest[0]) if rest else first)
    for m in rest:
        out = F.when(m.isNull(), out).otherwise(F.map_concat(without(out, m), m))
    return out


def spread(x: ColumnLike) -> Column:
    """The object itself."""
    return col(x)


def _path(path: str) -> str:
    return "$" + "".join(f".{p}" if p.isidentifier() else f"['{p}']" for p in path.split(".") if p)


def lookup(document: ColumnLike, path: str, kind: str = "string") -> Column:
    """The value at a dotted path of a VARIANT; NULL if it isn't there or of another type."""
    return F.try_variant_get(col(document), _path(path), kind)


def parse(text: ColumnLike) -> Column:
    """JSON text as VARIANT; NULL if it is none, or JSON's null."""
    v = F.try_parse_json(col(text))
    return F.when(~F.is_variant_null(v), v)


def document_type(document: ColumnLike) -> Column:
    """As type_of, of a VARIANT: by what each row holds."""
    document = col(document)
    held = F.schema_of_variant(document)
    return (
        F.when(document.isNull() | (held == "VOID"), "null").when(held == "BOOLEAN", "boolean").when(held == "STRING", "string").when(held.startswith("ARRAY"), "array")
        .when(held.startswith("OBJECT"), "object").when(held.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number").otherwise("undefined")
    )


def document_keys(document: ColumnLike) -> Column:
    """Sorted keys of a VARIANT object; NULL of anything else."""
    return json_keys(F.to_json(col(document)))


def document_values(document: ColumnLike) -> Column:
    """Values of a VARIANT object as VARIANT, in the order of their sorted keys."""
    entries = F.try_variant_get(col(document), "$", "map<string,variant>")
    return F.when(document_type(document) == "object", F.transform(keys(entries), lambda k: entries[k]))


def extract(document: ColumnLike, path: str, kind: str = "string") -> Column:
    """As lookup, but a step that isn't there fails the query.  Of no document, or null, the value is NULL."""
    document = col(document)
    steps = [p for p in path.split(".") if p]
    missing = F.lit(False)
    for k in range(len(steps)):
        parent = document if not k else F.try_variant_get(document, _path(".".join(steps[:k])), "variant")
        missing |= F.coalesce(~F.array_contains(F.coalesce(F.json_object_keys(F.to_json(parent)), F.array().cast("array<string>")), steps[k]), F.lit(True))
    value = F.when(missing, F.raise_error(F.concat(F.lit(f"no path {path} in "), F.to_json(document))).cast(kind)).otherwise(F.try_variant_get(document, _path(path), kind))
    return F.when(document.isNotNull() & ~F.coalesce(F.is_variant_null(document), F.lit(False)), value)
