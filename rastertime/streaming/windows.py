"""Event streams: the windowed aggregates of the batch operators with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, length: str = "1 day", keys: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Count, sum and extremes per window and key; on a stream, windows close ``late`` after their end."""
    events = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("_ts", late) if late else events
    out = events.groupBy(F.window("_ts", length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total", "low", "high")


def hopping(events: DataFrame, length: str, slide: str, keys: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    events = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("_ts", late) if late else events
    out = events.groupBy(F.window("_ts", length, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean")


def running_totals(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Count and sum of all events of a key so far, whenever it has new ones; two numbers of state a key, no event kept.

    A NULL value counts as an event and adds nothing. The key must be text; write in update mode.
    """

    def add(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [of[0]], "n": [n], "total": [total]})

    out = f"{key} string, n long, total double"
    return events.select(key, "value").groupBy(key).applyInPandasWithState(add, out, "n long, total double", "update", GroupStateTimeout.NoTimeout)


def start(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Writes closed windows to Parquet; ``once`` takes all that is there and stops."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
