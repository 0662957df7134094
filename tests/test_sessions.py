"""Streams of sessions over several batches, with rows out of order, late rows and restarts, against the batch result."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from rastertime.streaming import sessions as S
from rastertime.streaming.windows import SCHEMA, read_events

START = dt.datetime(2024, 1, 1)


def written(spark, folder, batches):
    """One file a batch, read in the order of their times."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}-{k}")
        os.makedirs(folder, exist_ok=True)
        for name in os.listdir(f"{folder}-{k}"):
            if name.endswith(".parquet"):
                shutil.move(f"{folder}-{k}/{name}", f"{folder}/{k}.parquet")
                os.utime(f"{folder}/{k}.parquet", (1_000_000 + k, 1_000_000 + k))


def event(i, minutes, user, kind="view", value=1.0):
    return (i, START + dt.timedelta(minutes=minutes), user, kind, value, "{}")


def shuffled(seed, late=False):
    """Three batches; within each, and up to half an hour across them, rows are out of order."""
    rng = random.Random(seed)
    rows = [event(i, rng.randrange(0, 3000), rng.randrange(6), rng.choice(["view", "buy"]), rng.choice([1.0, 2.5, None])) for i in range(400)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(-20, 20)))
    return [rows[:150], rows[150:300], rows[300:]]


def run(spark, stream, out, checkpoint):
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(300)


END = [event(9999, 100_000, 99)]  # closes all else


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches = shuffled(1)
    late = [event(5000, 1, 0), event(5001, 2, 1), event(5002, 3, 2)]
    written(spark, folder, [*batches, late, END])
    counter = S.LateRows()
    spark.streams.addListener(counter)
    try:
        stream = S.sessions(S.watched(read_events(spark, folder, files=1)), "40 minutes", late="1 hour")
        run(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        import time

        for _ in range(50):
            if counter.rows >= 404:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counter)
    want = S.sessions(spark.createDataFrame([r for b in batches for r in b], SCHEMA), "40 minutes")
    got = spark.read.schema(want.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert counter.rows == 404 and counter.dropped == 3 and counter.newest == END[0][1]


def plain_visits(rows, gap):
    out = []
    for user in {r[2] for r in rows}:
        now = None
        for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[3])):
            if now is None or r[1] - now[1] >= gap:
                now = [r[1], r[1], 0, 0.0, r[3], r[3], user]
                out.append(now)
            now[1], now[2], now[3], now[5] = r[1], now[2] + 1, now[3] + (r[4] or 0.0), r[3]
    return sorted((u, a.isoformat(), b.isoformat(), n, total, o, c) for a, b, n, total, o, c, u in out)


@pytest.mark.parametrize("seed", [2, 3])
def test_visits_over_restarts(spark, tmp_path, seed):
    """Each batch is a run of its own that goes on with the state of the one before; timers close sessions whose key is silent."""
    for k, v in S.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
        batches = shuffled(seed)
        for k, rows in enumerate([*batches, [event(7000, 1, 3)], END]):
            written(spark, f"{folder}-part{k}", [rows])
            import os

            os.makedirs(folder, exist_ok=True)
            shutil.move(f"{folder}-part{k}/0.parquet", f"{folder}/{k}.parquet")
            run(spark, S.visits(read_events(spark, folder), 40 * 60), out, state)
        micros = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss").alias(c)
        got = spark.read.parquet(out).select("user_id", micros("first"), micros("last"), "n", "total", "opened", "closed").collect()
        assert sorted(tuple(r) for r in got) == plain_visits([r for b in batches for r in b], dt.timedelta(minutes=40))
    finally:
        for k in S.STATE_STORE:
            spark.conf.unset(k)


def test_merging():
    a, b, c = (10, 10, 1, 1.0, "x", "x"), (14, 14, 1, 2.0, "y", "y"), (30, 30, 1, 4.0, "z", "z")
    assert S.merged([c, b, a], 5) == [(10, 14, 2, 3.0, "x", "y"), c]
    assert S.merged([(10, 14, 2, 3.0, "x", "y"), (12, 12, 1, 1.0, "m", "m")], 5) == [(10, 14, 3, 4.0, "x", "y")]
    assert S.merged([], 5) == []
