import datetime as dt

from pyspark.sql import functions as F

from rastertime.sources import sinks as K
from rastertime.sources.catalog import landsat, merge, missing_bands
from rastertime.streaming import windows as W


def test_names():
    assert K.collection_name("My  Fine Name", 1995, 2001, 1, 365) == "My-Fine-Name_1995_2001_1_365"


def test_collection_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1995, 0.5, 290.0), (2, 1996, None, 300.0)], "px int, year int, nir double, temp double")
    path = K.export_collection(df, str(tmp_path), "out", (1995, 1996), (1, 365), ["nir", "temp"])
    got = {r.px: (r.nir, r.temp, r.year) for r in spark.read.parquet(path).collect()}
    assert got == {1: (5000, 290, 1995), 2: (-32768, 300, 1996)}
    K.copy(spark, path, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def test_catalogue_reads_its_bands_only(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7, 8, 9)], "SR_B1 int, SR_B2 int, SR_B3 int, SR_B4 int, SR_B5 int, ST_B6 int, SR_B7 int, QA_PIXEL int, other int").write.parquet(str(tmp_path / "c"))
    df = landsat(str(tmp_path / "c"), ("C2", 5, "SR")).read(spark)
    assert df.columns == ["blue", "green", "red", "nir", "swir1", "temp", "swir2", "qa"] and df.first().swir2 == 7


def test_merge_fills_missing_bands(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert sorted((r.x, r.y) for r in merge(a, b).collect()) == [(1, None), (2, 3)]
    assert missing_bands(a, ["x", "z"]).columns == ["x", "z"]


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), i % 3, "ab"[i % 2], float(i), None) for i in range(100)]
    spark.createDataFrame(rows, W.SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    out = W.tumbling(W.read_events(spark, str(tmp_path / "in")), "1 day", late="1 hour")
    W.start(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    batch = {(r.start, r.event_type): r.n for r in W.tumbling(spark.read.parquet(str(tmp_path / "in"))).collect()}
    stream = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stream and all(batch[k] == n for k, n in stream.items())
    hop = W.hopping(spark.read.parquet(str(tmp_path / "in")), "2 days", "1 day").agg(F.sum("n")).first()[0]
    assert hop == 200
