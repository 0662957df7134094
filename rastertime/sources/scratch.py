"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rastertime-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, files: int | None = None) -> DataFrame:
    """Writes a table, in at most so many files, and reads it again: cuts the lineage, and the constraints that a loop would pile up."""
    path = f"{shared_dir(df.sparkSession)}/rt-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    for scope in getattr(_scopes, "open", ()):
        scope.append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Writes the table that ``make`` returns, then deletes every other one that ``materialise`` wrote on the way to it."""
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        out = materialise(make())
    finally:
        made = scopes.pop()
    release(*(t for t in made if t is not out))
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once no later job reads it."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path:
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
