"""Classifiers on labels that can be learned, at points and in polygons; parameters, masks and kept models."""

import random

import pytest
from pyspark.sql import functions as F

from rastertime.operators import classification as K
from rastertime.operators.classify import names_to_numbers
from rastertime.operators.polygons import RINGS


def cells(spark, n=600):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        kind = ["bare", "crop", "wood"][i % 3]
        at = {"bare": (0.1, 0.8), "crop": (0.5, 0.5), "wood": (0.9, 0.1)}[kind]
        rows.append((i, i // 30, i % 30, kind, *[x + rng.gauss(0, 0.06) for x in at]))
    return spark.createDataFrame(rows, "px long, row long, col long, kind string, a double, b double")


@pytest.mark.parametrize("kind", ["random_forest", "tree", "naive_bayes", "logistic"])
def test_held_out_points(spark, kind):
    df = cells(spark)
    model, out = K.classified_points(df, df.where("px % 2 = 0").select("px", "kind"), ["px"], "kind", ["a", "b"], kind)
    held = out.where("px % 2 = 1").collect()
    names = ["bare", "crop", "wood"]
    assert len(held) == 300 and sum(names[int(r.classified)] == r.kind for r in held) > 290


def test_polygons_learn_from_polygons(spark):
    df = cells(spark, 900).withColumns({"a": F.col("row") / 30 + F.col("a") / 20})
    squares = [(k, [[(x - 0.5, y - 0.5), (x + 2.5, y - 0.5), (x + 2.5, y + 2.5), (x - 0.5, y + 2.5)]], "north" if y < 15 else "south") for k, (y, x) in enumerate((y, x) for y in range(0, 30, 3) for x in range(0, 30, 3))]
    areas = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings], side) for k, rings, side in squares], f"k int, rings {RINGS}, side string")
    made = {"mean_a": F.avg("a"), "sd_b": F.stddev_pop("b")}
    _, out = K.classified_polygons(df.select("row", "col", "a", "b"), areas.where("k % 2 = 0"), areas.where("k % 2 = 1"), ["k"], "side", made, trees=5, seed=1, tile=8)
    got = {r.k: r.classified for r in out.collect()}
    assert len(got) == 50 and all(got[k] == (side == "south") for k, _, side in squares if k % 2)


def test_modes_masks_and_kept_models(spark, tmp_path):
    df = cells(spark).withColumn("a", F.when(F.col("px") % 10 > 0, F.col("a"))).withColumn("classified", F.lit("old"))
    model, out = K.classified_points(df, df.where("px % 2 = 0").select("px", "kind"), ["px"], "kind", ["a", "b"], mode="PROBABILITY", trees=5, seed=3)
    rows = out.collect()
    assert len(rows) == 600 and all((r.classified is None) == (r.px % 10 == 0) == (r.probability is None) for r in rows)
    assert all(len(r.probability) == 3 and abs(sum(r.probability) - 1) < 1e-9 for r in rows if r.probability)
    model.write().save(str(tmp_path / "model"))
    again = K.classify(df, K.load(str(tmp_path / "model")), "PROBABILITY")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))
    _, line = K.classified_points(df, df.select("px", (F.col("b") * 2 + 1).alias("y")), ["px"], "y", ["b"], "logistic", "REGRESSION")
    assert all(r.classified == pytest.approx(r.b * 2 + 1, abs=1e-3) for r in line.limit(50).collect())


def test_errors_name_what_is_known():
    for make, word in ((lambda: K.estimator("oracle"), "random_forest"), (lambda: K.estimator("tree", "GUESS"), "PROBABILITY"), (lambda: K.estimator("tree", forest=1), "depth"), (lambda: K.estimator("naive_bayes", "REGRESSION"), "naive_bayes")):
        with pytest.raises(ValueError, match=word):
            make()


def test_nearest_centres(spark):
    train = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 0.0), (1, 5.0, 0.0), (2, None, 9.0), (None, 5.0, 5.0)], "k int, a double, b double")
    found = K.centres(train, ["a", "b"], "k")
    assert found == [(0, 1.0, 0.0), (1, 5.0, 0.0)]
    rows = spark.createDataFrame([(3.0, 0.0), (4.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r.classified for r in K.nearest_centre(rows, found, ["a", "b"]).collect()] == [0, 1, None]
    assert K.nearest_centre(rows, [], ["a"]).where("classified IS NULL").count() == 3


def test_names_are_numbered_over_ranges(spark):
    names = [f"n{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(x,) for x in [*names, None, "n0003"]], "name string").repartition(7)
    got = {r.name: r.code for r in names_to_numbers(df, "name", "code").collect()}
    assert got == {None: None} | {x: i for i, x in enumerate(names)}
