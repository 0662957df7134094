"""Exports read back, grids turned and moved, filters that reach the scan, expressions with texts."""

import glob
import json
import os
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.operators.reproject import Grid, reproject, target_cells
from rastertime.plans.pipelines import Options
from rastertime.sources import exports as E
from rastertime.sources.catalog import metadata


def composites(spark):
    return spark.createDataFrame([(px, y, 0.1234 * px, None if px == 2 else 280.0 + y % 5) for y in (1996, 1997, 1998) for px in range(4)], "px int, year int, nir double, temp double")


def test_composites_come_back_with_their_options(spark, tmp_path):
    path = str(tmp_path / "out")
    made = E.properties(spark, "my  area/x", Options(method="median", stats=composites(spark)), (1995, 1999), (152, 273), 1, "median", "SR")
    E.export_composites(composites(spark), path, ["nir", "temp"], made)
    first = sorted(map(repr, E.read_composites(spark, path).collect()))
    E.export_composites(composites(spark), path, ["nir", "temp"], made)
    rows = E.read_composites(spark, path)
    assert sorted(map(repr, rows.collect())) == first and rows.count() == 12
    one = rows.where("px = 3 AND year = 1997").first()
    assert one.nir == pytest.approx(0.3702, abs=1e-4) and one.temp == 282 and one.exportName == "my-area-x_SR_median_1996_1998_152_273"
    assert rows.where("px = 2 AND temp IS NULL").count() == 3
    said = json.loads(one.options)
    assert said["method"] == "median" and said["stats"] == ["nir", "px", "temp", "year"]
    assert str(one.time_start) == "1997-06-01" and (one.startYearComposite, one.endYearComposite) == (1996, 1998)


def test_a_failed_export_leaves_no_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    made = E.properties(spark, "a", {}, (1996, 1998), (152, 273))
    broken = composites(spark).withColumn("nir", F.when(F.col("px") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("nir")))
    with pytest.raises(Exception, match="lost"):
        E.export_composites(broken, path, ["nir"], made)
    assert not os.path.exists(f"{path}/properties") and not glob.glob(f"{path}/data/exportName=*/*.parquet")


def test_placemarks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.5, -3.25, 'a < b & "c"'), (2, 0.0, 1.0, None), (3, None, 1.0, "lost")], "id int, x double, y double, note string").repartition(2)
    E.export_kml(rows, str(tmp_path / "kml"), "x", "y", "id")
    found = {}
    for file in glob.glob(str(tmp_path / "kml" / "part-*")):
        ns = {"k": "http://www.opengis.net/kml/2.2"}
        for mark in ET.parse(file).getroot().iterfind(".//k:Placemark", ns):
            data = {d.get("name"): d.findtext("k:value", namespaces=ns) for d in mark.iterfind(".//k:Data", ns)}
            found[mark.findtext("k:name", namespaces=ns)] = (mark.findtext(".//k:coordinates", namespaces=ns), data)
    assert found == {"1": ("10.5,-3.25", {"id": "1", "note": 'a < b & "c"'}), "2": ("0.0,1.0", {"id": "2", "note": ""})}


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "scenes")
    rows = [("L8_a", 5, ["VV"]), ("L7_b", 9, ["VH"]), (None, None, None)]
    spark.createDataFrame(rows, "name string, cover int, bands array<string>").write.parquet(path)
    df = spark.read.parquet(path)
    ask = lambda *f: [r.name for r in df.where(metadata(*f)).collect()]
    assert ask("name", "contains", "8_") == ["L8_a"] and ask("name", "not_contains", "8_") == ["L7_b"] and ask("name", "ends_with", "b") == ["L7_b"]
    assert ask("cover", "in_list", [9, 11]) == ["L7_b"] and ask("cover", "not_greater_than", 5) == ["L8_a"] and ask("bands", "list_contains", "VV") == ["L8_a"]
    plan = df.where(metadata("name", "contains", "8_") & metadata("cover", "in_list", [5, 6]))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(name,8_)" in plan and "In(cover, [5,6])" in plan
    with pytest.raises(ValueError, match="starts_with"):
        metadata("name", "like", "x")


def test_expressions_leave_texts_fields_and_functions(spark):
    row = spark.createDataFrame([(2.0, 3.0, "N")], "nir double, red double, sensor string")
    got = row.select(
        B.expression("N * 2D + R", {"N": "nir", "R": "red"}).alias("a"),
        B.expression("concat('it''s N ', S, ' \"R\"')", {"N": "nir", "R": "red", "S": "sensor"}).alias("b"),
        B.expression("named_struct('R', N).R", {"N": "nir", "R": "red"}).alias("c"),
        B.expression("abs(N - R) * abs", {"N": "nir", "R": "red", "abs": "nir"}).alias("d"),
    ).first()
    assert (got.a, got.b, got.c, got.d) == (7.0, 'it\'s N N "R"', 2.0, 2.0)


def test_grids_there_and_back(spark):
    z = np.random.default_rng(4).normal(size=(9, 11))
    df = spark.createDataFrame([(r - 3, c - 4, float(z[r, c])) for r in range(9) for c in range(11)], "row long, col long, z double")
    turned = Grid(7.0, -2.0, 0.0, -1.0, 1.0, 0.0)
    there = reproject(df, ["z"], Grid(), turned)
    assert there.count() == 99
    back = reproject(there, ["z"], turned, Grid())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("row", "col", "z").collect()))
    moved = reproject(df, ["z"], Grid(), Grid().translated(2, -1))
    assert {(r.row - 1, r.col + 2): r.z for r in moved.collect()} == {(r.row, r.col): r.z for r in df.collect()}
    fine = {(r.row, r.col): r.z for r in reproject(df, ["z"], Grid(), Grid(0, 0, 0.5, 0, 0, 0.5), "bilinear").collect()}
    assert fine[0, 1] == pytest.approx((z[3, 4] + z[3, 5]) / 2) and fine[1, 1] == pytest.approx(z[3:5, 4:6].mean())
    skew = Grid(0.5, 0.25, 1.5, 0.5, -0.25, 2.0)
    want = {}
    for r in df.collect():
        row, col = ((r.row - 0.25) * 1.5 - (r.col - 0.5) * -0.25) / 3.125, ((r.col - 0.5) * 2.0 - (r.row - 0.25) * 0.5) / 3.125
        want.setdefault((int(np.floor(round(row, 9) + 0.5)), int(np.floor(round(col, 9) + 0.5))), []).append(r.z)
    got = {(r.row, r.col): r.z for r in reproject(df, ["z"], Grid(), skew, "mean").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(np.mean(v)) for k, v in want.items())
    cells = {(r.row, r.col) for r in target_cells(df, Grid(), skew, 4).collect()}
    assert set(want) <= cells
    with pytest.raises(ValueError):
        Grid(0, 0, 1, 1, 1, 1).cell(F.lit(1.0), F.lit(1.0))
