import pytest
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.operators import clouds as K
from rastertime.operators import focal as L
from rastertime.sources import catalog as C
from rastertime.streaming import windows as W
from tests.conftest import SF


def cells(spark, text):
    """Rows of digits as one image; a dot is a masked cell."""
    rows = [("a", r, c, None if x == "." else int(x)) for r, line in enumerate(text.split()) for c, x in enumerate(line)]
    return spark.createDataFrame(rows, "t string, row long, col long, v int")


def kept(out):
    rows = {(r.row, r.col): r.keep for r in out.collect()}
    height, width = max(k[0] for k in rows) + 1, max(k[1] for k in rows) + 1
    return ["".join("1" if rows[r, c] else "0" for c in range(width)) for r in range(height)]


def test_specks_go_and_areas_get_a_margin(spark):
    a = cells(spark, "1111111 1011111 1111111 1111000 1111000 1111000")
    assert kept(K.with_margin(a, F.col("v") == 1, 1, 2)) == ["1111111", "1111111", "1111100", "1111000", "1110000", "1110000"]


def test_null_cells_stay_masked_and_pull_nobody(spark):
    a = cells(spark, "111 1.1 111")
    assert kept(K.with_margin(a, F.col("v") == 1, 1, 1)) == ["111", "101", "111"]


def test_images_don_t_see_each_other(spark):
    a = cells(spark, "111 111")
    b = cells(spark, "000 000").withColumn("t", F.lit("b"))
    out = K.with_margin(a.union(b), F.col("v") == 1, 1, 1)
    assert {(r.t, r.keep) for r in out.collect()} == {("a", True), ("b", False)}
    assert K.with_margin(a.where("false"), F.col("v") == 1, 1, 1).count() == 0


@pytest.mark.parametrize("family", ["landsat", "sentinel2", "modis"])
def test_catalogues_rename_and_scale(spark, tmp_path, family):
    products = {"landsat": C.LANDSAT_BANDS, "sentinel2": C.S2_BANDS, "modis": C.MODIS_BANDS}[family]
    for i, product in enumerate(products):
        source = getattr(C, family)(str(tmp_path / str(i)), product)
        raw = spark.range(1).select(F.lit(1).alias("px"), F.lit("x").alias("unused"), *[F.lit(10000).alias(b) for b in source.bands])
        raw.write.parquet(source.path)
        row = source.read(spark, ("px",)).first()
        assert row.__fields__ == ["px", *source.bands.values()] and row.px == 1
        for name in source.bands.values():
            assert row[name] == pytest.approx({"landsat": 10000, "sentinel2": 1}.get(family, 10000 * C.MODIS_FACTORS.get(name, 1)))


def test_landsat_names_are_complete():
    assert len(C.LANDSAT_BANDS) == 18 and all(len(b) == len(C.NAMES) for b in C.LANDSAT_BANDS.values())
    assert C.LANDSAT_BANDS["C2", 9, "SR"] == ["SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "ST_B10", "SR_B7", "QA_PIXEL"]
    assert C.LANDSAT_BANDS["C1", 7, "TOA"] == ["B1", "B2", "B3", "B4", "B5", "B6_VCID_1", "B7", "BQA"] and C.LANDSAT_BANDS["C1", 7, "SR"][5] == "B6"


def test_colours_of_black_grey_and_masked(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (0.4, 0.4, 0.4), (0.0, 0.5, None), (0.5, 0.0, 0.25)], "r double, g double, b double")
    out = [r.h for r in rows.select(B.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")).alias("h")).collect()]
    assert tuple(out[0]) == (0, 0, 0) and tuple(out[1]) == (0, 0, 0.4) and tuple(out[2]) == (None, None, None)
    assert tuple(out[3]) == pytest.approx((11 / 12, 1, 0.5))


def test_bicubic_keeps_planes_and_needs_all_cells(spark):
    plane = spark.createDataFrame([(r, c, 2.0 * r - 3.0 * c) for r in range(5) for c in range(5)], "row long, col long, z double")
    points = spark.createDataFrame([(1.25, 2.5), (2.0, 1.0), (0.5, 2.0)], "y double, x double")
    out = {(r.y, r.x): r.z for r in L.bicubic(plane, points, "z").collect()}
    assert out[1.25, 2.5] == pytest.approx(-5) and out[2.0, 1.0] == pytest.approx(1) and out[0.5, 2.0] is None


def test_running_totals_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "events")
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_type", F.col("value").cast("double").alias("value"))
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = W.running_totals(stream).writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    seen = spark.table("running")
    last = {r.event_type: (r.n, round(r.total, 6)) for r in seen.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")).collect()}
    want = {r.event_type: (r.n, round(r.total, 6)) for r in events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    assert last == want and seen.count() > len(want)
