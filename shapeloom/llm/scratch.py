"""Written tables that cut lineage.

They go below ``spark.checkpoint.dir``, the folder that the driver and all executors share, so a lost
executor costs a reread and not a rerun.  ``release`` drops them; a table that is still needed lazily must
not be released, so the operators never do it themselves.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_held: dict[str, list] = {}


def root(spark: SparkSession) -> str:
    """The shared folder; in a session without one (tests on one machine) a temporary one is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shapeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/shapeloom/{name}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(release)
    _held.setdefault(path, [spark])
    return path


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back with its schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """An aggregate that is joined with what it was made from, kept from sharing that shuffle: only between
    shuffles of its own can AQE split a join's hot key."""
    return df.hint("rebalance")


def held() -> list[str]:
    """The tables written and not yet released, in their order."""
    return list(_held)


def release(paths: Iterable[str] | None = None) -> None:
    """Delete these tables, or all written so far.  Only when no result that reads them is still to be computed."""
    for path in held() if paths is None else list(paths):
        (spark,) = _held.pop(path)
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            _held.clear()
            return
