"""Sessions of events: windows that a pause closes, on tables and on streams, and a count of the rows that came too late.

``sessions`` leaves the work to Spark's session windows. ``visits`` keeps what an aggregate of session windows can't tell:
for each key the sessions still open, as a list in state, and a timer for the next to close. State outlives a restart, as both
live in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

#: What a stream with ``visits`` needs of its session: a state store with column families.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    events = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("_ts", late) if late else events


def sessions(events: DataFrame, gap: str = "6 hours", keys: tuple[str, ...] = ("user_id",), late: str | None = None) -> DataFrame:
    """(keys, began, ended, n, total) per run of events of a key without a pause of ``gap``; ended is the last event plus it.

    On a stream a session leaves once the watermark, ``late`` behind the newest event, has passed its end. Events older than
    that are dropped; ``LateRows`` counts them. Events without a time or a key are a session of none and a key of its own.
    """
    out = _timed(events, late).where(F.col("_ts").isNotNull()).groupBy(F.session_window("_ts", gap).alias("w"), *keys)
    out = out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "total")


def watched(events: DataFrame, name: str = "arrived") -> DataFrame:
    """The events, observed: every batch tells how many came and the newest time among them."""
    return events.observe(name, F.count(F.lit(1)).alias("rows"), F.max("ts").alias("newest"))


class LateRows(StreamingQueryListener):
    """Sums over a session's streams what ``watched`` observed and what stateful operators dropped as too late.

    Rows of one key and time that come in one batch reach the operator as one, and count so when they are dropped.
    """

    def __init__(self, name: str = "arrived"):
        self.name, self.rows, self.dropped, self.newest = name, 0, 0, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get(self.name)
        if got is not None:
            self.rows += got.rows
            self.newest = max(x for x in (self.newest, got.newest) if x is not None) if self.newest or got.newest else None
        self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


OPEN = "first long, last long, n long, total double, opened string, closed string"


def merged(found: list[tuple], gap: int) -> list[tuple]:
    """Sessions (first, last, n, total, opened, closed) joined where one begins less than ``gap`` after another ends."""
    out: list[tuple] = []
    for s in sorted(found, key=lambda s: (s[0], s[1], str(s[4]))):
        if out and s[0] - out[-1][1] < gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] + s[3], a[4], s[5] if s[1] >= a[1] else a[5])
        else:
            out.append(s)
    return out


class Visits(StatefulProcessor):
    """Open sessions of a key; times in microseconds."""

    def __init__(self, gap: int, key: str):
        self.gap, self.key = gap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        for pdf in rows:
            new = [(int(t), int(t), 1, 0.0 if pd.isna(v) else float(v), k, k) for t, v, k in zip(pdf["us"], pdf["value"], pdf["kind"])]
            found = merged([*found, *new], self.gap)
        yield self._closed(key, found, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        yield self._closed(key, found, timerValues.getCurrentWatermarkInMs())

    def _closed(self, key, found: list[tuple], watermark_ms: int) -> pd.DataFrame:
        """Keeps the sessions that later events may still join, with a timer for the next to end, and returns the others."""
        over = [s for s in found if s[1] + self.gap <= watermark_ms * 1000]
        kept = found[len(over) :] if found[: len(over)] == over else [s for s in found if s not in over]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(-(-(min(s[1] for s in kept) + self.gap) // 1000))
        elif self.open.exists():
            self.open.clear()
        return pd.DataFrame([(key[0], *s) for s in over], columns=[self.key, "first", "last", "n", "total", "opened", "closed"]).astype({"first": "int64", "last": "int64", "n": "int64", "total": "float64"})

    def close(self) -> None:
        pass


def visits(events: DataFrame, gap_seconds: int = 6 * 3600, key: str = "user_id", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(key, first, last, n, total, opened, closed) per session of a stream: opened and closed are the kinds of its first and last event.

    A session is a run of a key's events less than the gap apart, in whatever order and batches they come, unless later
    than ``late``. It leaves by a timer when the watermark passes its last event plus the gap. State is six numbers for
    each open session, no event. Events without a time or key are left out; a NULL value adds nothing. Of events at one
    time the least kind opens. Write in append mode, under STATE_STORE.
    """
    rows = _timed(events.select("ts", key, kind, "value"), late).where(F.col("_ts").isNotNull() & F.col(key).isNotNull())
    rows = rows.select(key, "_ts", F.unix_micros("_ts").alias("us"), "value", F.col(kind).alias("kind"))
    schema = f"{key} {dict(events.dtypes)[key]}, first long, last long, n long, total double, opened string, closed string"
    return rows.groupBy(key).transformWithStateInPandas(Visits(gap_seconds * 1_000_000, key), schema, "append", "EventTime")
