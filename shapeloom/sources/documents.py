"""JSON bodies as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objects import parse


def parse_documents(df: DataFrame, body: str = "body", name: str = "document") -> DataFrame:
    """JSON text as VARIANT; NULL if it is none."""
    return df.withColumn(name, parse(F.col(body)))


def _items(document: Column, endpoint: str, filtered: bool) -> Column:
    many = lambda path: F.try_variant_get(document, path, "array<variant>")
    key = f"$['{endpoint}']"
    is_object = F.schema_of_variant(document).startswith("OBJECT")
    under = F.try_variant_get(document, key, "variant")
    one = F.when(F.schema_of_variant(under).startswith("OBJECT"), F.array(under))
    # a whole object is a record only where nothing is filtered
    alone = F.when(is_object & under.isNull() & ~F.lit(filtered), F.array(document))
    return F.coalesce(many("$"), F.when(is_object, many(key)), F.when(is_object, one), alone)


def elements(df: DataFrame, endpoint: str, filtered: bool = False, document: str = "document") -> DataFrame:
    """A row (position, element) per record of each document, beside the other columns.

    An array's elements; of an object the array, or the object, under the endpoint's name; without that, the
    object itself if no filter follows.  Anything else has no records.
    """
    rest = [c for c in df.columns if c != document]
    return df.select(*rest, F.posexplode(_items(F.col(document), endpoint, filtered)).alias("position", "element"))
