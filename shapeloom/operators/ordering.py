"""Order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, *terms: str, ordinal: str) -> DataFrame:
    """By numbers: ``f`` or ``<f`` ascending, ``>f`` descending, a missing one as 0; the ordinal column breaks ties."""
    keys = []
    for term in terms:
        name = term.lstrip("<>")
        key = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        keys.append(key.desc() if term.startswith(">") else key.asc())
    return df.orderBy(*keys, F.col(ordinal).asc())
