"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(scratch.apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(scratch.apart(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that has an edge; ``edges`` has two long columns.

    The component is its smallest id.  Every round moves edges towards the smallest ids and is written, so
    that lineage stays short; it ends when a round changes nothing.  No node's neighbours are gathered.
    """
    edges = scratch.table(edges.toDF("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    while True:
        edges = scratch.table(_small_star(_large_star(edges)), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.union(edges.select("v", "v")).toDF("id", "component").distinct()
        seen = state
