import numpy as np
from pyspark.sql import functions as F

from rastertime.operators import focal as L
from rastertime.operators import normalize as N
from rastertime.operators import patches


def frame(spark, a, name="v"):
    return spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], f"row long, col long, {name} double")


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[name] is None else r[name]
    return out


def test_circle_sizes():
    assert len(L.circle(0.5)) == 1 and len(L.circle(1.5)) == 9 and len(L.circle(1)) == 5


def test_erosion_and_dilation_against_loops(spark):
    a = np.random.default_rng(0).random((7, 6))
    got = array(L.focal_min(frame(spark, a), "v", 1.5), a.shape)
    want = np.array([[a[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].min() for c in range(6)] for r in range(7)])
    assert np.array_equal(got, want)


def test_sieve_removes_small_patches(spark):
    a = np.zeros((9, 9))
    a[0, 0] = 1  # one cell
    a[3:5, 3:5] = 2  # four cells
    a[7, 1:6] = 3  # five cells
    got = array(patches.sieve(frame(spark, a), "v", 4), a.shape)
    assert got[0, 0] == 0 and (got[7, 1:6] == 3).all() and not (got == 1).any()


def test_patches_of_a_spiral(spark):
    a = np.zeros((7, 7))
    a[0, :] = a[:, 6] = a[6, :] = a[2:, 0] = a[2, :5] = 1
    got = patches.patch_sizes(frame(spark, a), "v").where("v = 1").select("n").distinct().collect()
    assert len(got) >= 1 and max(r.n for r in got) == int(a.sum())


def test_lee_filter_keeps_flat_ground(spark):
    a = np.full((9, 9), 4.0)
    assert np.allclose(array(L.lee_filter(frame(spark, a), "v"), a.shape), 4.0)
    noisy = 4 + np.random.default_rng(0).normal(0, 0.4, (12, 12))
    smooth = array(L.lee_filter(frame(spark, noisy), "v"), noisy.shape)
    assert smooth[3:-3, 3:-3].std() < noisy[3:-3, 3:-3].std()


def test_components_are_uncorrelated(spark):
    x = np.random.default_rng(0).normal(size=(300, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0], [0, 0.3, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    pc = np.array([tuple(r) for r in N.principal_components(df, ["a", "b", "c"]).select("pc1", "pc2", "pc3").collect()])
    assert np.allclose(np.cov(pc.T, bias=True), np.eye(3), atol=1e-6)


def test_terrain_of_a_plane(spark):
    a = np.fromfunction(lambda r, c: r * 1.0, (5, 5))
    out = {(r.row, r.col): r for r in L.terrain(frame(spark, a, "z"), "z", 1.0).collect()}
    assert out[0, 0].slope is None and abs(out[2, 2].slope - 45) < 1e-9


def test_shadow_falls_away_from_the_sun(spark):
    clouds = spark.createDataFrame([(5, 5)], "row long, col long")
    dark = frame(spark, np.ones((11, 11)), "dark").withColumn("dark", F.col("dark").cast("int"))
    got = L.project_shadows(clouds, dark, 180.0, 45.0, [30, 60], 30.0, 0.5, 0.5).where("shadow = 1").collect()
    assert {(r.row, r.col) for r in got} == {(6, 5), (7, 5)}
