"""Filters and projections keep no state, so the same functions serve tables and streams.

Order and index need all rows and can't be streamed.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def open_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files below a path, those that come later too."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stateless(records: DataFrame, pipeline: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pipeline over a stream; one that needs state is refused."""
    out = pipeline(records)
    if records.isStreaming and not out.isStreaming:
        raise ValueError("the pipeline leaves the stream")
    if held := sorted(_nodes(out._jdf.queryExecution().analyzed()) & _STATEFUL):
        raise ValueError(f"the pipeline needs state: {', '.join(held)}")
    return out


_STATEFUL = {"Aggregate", "Sort", "Window", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "DeduplicateWithinWatermark"}


def _nodes(plan) -> set[str]:
    """Names of a plan's nodes."""
    children = plan.children()
    return {plan.nodeName()}.union(*(_nodes(children.apply(k)) for k in range(children.size())))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shapeloom-stream-")
    return folder.rstrip("/")


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Writes what is there now as Parquet; run again with the same checkpoint, only what is new."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
