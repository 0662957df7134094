"""Queries of the models on synthetic tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertime.functions import ccdc as C
from rastertime.operators import models as M
from rastertime.plans import models as Q


def test_forest_reads_every_component(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 64))
    rows = [(k, x.tolist(), int(x[40] > 0)) for k, x in enumerate(v)] + [(600, None, 1), (601, [None] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.random_forest(spark, str(tmp_path)).withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(10)) >= 7).collect()
    assert {r.vec_id for r in got} == set(range(600))
    held = [r.label == r.classified for r in got if r.held]
    assert len(held) > 100 and np.mean(held) > 0.9


def break_of_swir1():
    t = np.arange(2000, 2008, 1 / 12)
    rng = np.random.default_rng(0)
    nir, swir1 = (0.5 + 0.1 * np.cos(2 * np.pi * t) + rng.normal(0, 0.01, len(t)) for _ in range(2))
    swir1[t >= 2004] -= 0.25
    return t, nir, swir1


@pytest.mark.parametrize("penalty", [0.0, 0.002])
def test_a_break_of_the_second_band_has_its_magnitude(spark, penalty):
    t, nir, swir1 = break_of_swir1()
    df = spark.createDataFrame([(1, *map(float, x)) for x in zip(t, nir, swir1)], "px long, t_dec double, nir double, swir1 double")
    out = M.ccdc(df, ["nir", "swir1"], ["px"], penalty=penalty)
    segs = out.first().segs
    assert len(segs) == 2 and segs[0].tBreak == pytest.approx(2004, abs=0.1)
    assert segs[0].mag["swir1"] == pytest.approx(-0.25, abs=0.05) and abs(segs[0].mag["nir"]) < 0.05
    assert all(len(segs[0].coefs[b]) == 8 and segs[0].coefs[b][2] == pytest.approx(0.1, abs=0.02) for b in ("nir", "swir1"))
    got = out.select(C.changes(C.of_band(F.col("segs"), "swir1"))["largest_loss_mag"].alias("m")).first().m
    assert got == segs[0].mag["swir1"]


def test_lasso():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(60), rng.normal(size=(60, 3)) * [1, 5, 0.1]])
    v = x @ np.array([[1.0, 0], [2, 0.001], [0, 0.5], [0.5, 0]]) + rng.normal(0, 0.01, (60, 2))
    assert np.allclose(M.lasso(x, v, 0.0, 25_000), np.linalg.lstsq(x, v, rcond=None)[0], atol=1e-6)
    got, sd = M.lasso(x, v, 0.05, 25_000), x[:, 1:].std(axis=0)
    slope = (x[:, 1:] / sd).T @ (v - x @ got) / len(x)  # the conditions of the minimum
    assert np.allclose((v - x @ got).mean(axis=0), 0, atol=1e-9) and np.abs(slope).max() <= 0.05 + 1e-7
    on = got[1:] != 0
    assert np.allclose(slope[on], 0.05 * np.sign(got[1:][on]), atol=1e-7) and not on.all()


def test_series_fitted_at_once_are_as_one_by_one(spark):
    rng = np.random.default_rng(4)
    series = []
    for k in range(24):
        t = np.sort(rng.uniform(2000, 2008, rng.integers(5, 90))) if k % 4 else 2000 + np.arange(16) / 2  # of which waves of half a year are alike
        v = 0.5 + 0.1 * np.cos(2 * np.pi * t)[:, None] + rng.normal(0, 0.02, (len(t), 2))
        v[t > 2004] -= 0.3 * (k % 2)
        v[rng.integers(0, len(t))] += 0.4
        series.append((t, v))
    rows = [(None if k == 7 else 2**60 + k, float(a), *map(float, b)) for k, (t, v) in enumerate(series) for a, b in zip(t, v)]
    df = spark.createDataFrame([*rows, (2**60, 2001.1, None, 0.3), (1, 2001.1, float("nan"), 0.3)], "px long, t_dec double, nir double, swir1 double")
    got = {r.px: r.segs for r in M.ccdc(df, ["nir", "swir1"], ["px"]).collect()}
    assert set(got) == {None if k == 7 else 2**60 + k for k in range(24)}
    for k, (t, v) in enumerate(series):
        mine, own = got[None if k == 7 else 2**60 + k], M.continuous_change(t, v)
        assert [(s.tStart, s.tEnd, s.tBreak) for s in mine] == [(s["tStart"], s["tEnd"], s["tBreak"]) for s in own]
        for a, b in zip(mine, own):
            assert np.allclose([a.coefs["nir"], a.coefs["swir1"]], b["coefs"], atol=1e-6) and np.abs(np.array(b["coefs"])[:, 1:]).max() < 1
    assert any(len(s) > 1 for s in got.values())


def test_many_series_are_fitted_in_little_time():
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(1995, 2002, (150, 200)), axis=1)
    began = time.process_time()
    found = M.continuous_changes(t, rng.uniform(0, 1, (150, 200, 2)), np.full(150, 200), 6, 0.99, 1.33, 0.002, 25_000)
    assert len(found) == 150 and time.process_time() - began < 10
