"""Micro-fixtures of the time operators and synthetic signals for the models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertime.functions import segments as S
from rastertime.operators import change as X
from rastertime.operators import composite as P
from rastertime.operators import models as M
from rastertime.operators import regress as R


def verts(spark, *points):
    df = spark.createDataFrame([(1, [{"yr": y, "fit": f} for y, f in points])], "px int, v array<struct<yr: int, fit: double>>")
    return df


def test_loss_then_gain(spark):
    df = verts(spark, (1995, -0.6), (1998, -0.2), (2001, -0.5))
    wide = S.top(S.loss_gain(F.col("v"), "loss"), 2, "loss") | S.top(S.loss_gain(F.col("v"), "gain"), 2, "gain")
    r = df.select(*[c.alias(n) for n, c in wide.items()]).first()
    assert (r.loss_yr_1, r.loss_dur_1, round(r.loss_mag_1, 6), r.loss_yr_2) == (1998, 3, -0.4, None)
    assert (r.gain_yr_1, r.gain_dur_1, round(r.gain_mag_1, 6), r.gain_yr_2) == (2001, 3, 0.3, None)


def test_equal_losses_go_by_year(spark):
    df = verts(spark, (1995, 0.0), (1996, 0.5), (1997, 0.0), (1998, 0.5))
    r = df.select(S.loss_gain(F.col("v"), "loss").alias("x")).first().x
    assert [s.yr for s in r] == [1996, 1998]


def test_membership_of_years(spark):
    df = verts(spark, (1995, 0.0), (1998, 3.0), (2000, 3.0))
    got = {r.year: (r.dur, round(r.fit, 9)) for r in S.annual_from_segments(df, "v", 1995, 2001, ["px"]).collect()}
    assert got == {1995: (3, 0), 1996: (3, 1), 1997: (3, 2), 1998: (3, 3), 1999: (2, 3), 2000: (2, 3)}
    fit = {r.year: r.fit for r in S.annual_fit(df, "v", 1994, 2001, ["px"]).collect()}
    assert fit[1994] is None and fit[2001] is None and fit[1999] == 3.0


def test_empty_and_single_vertex(spark):
    df = spark.createDataFrame([(1, []), (2, [{"yr": 1995, "fit": 1.0}])], "px int, v array<struct<yr: int, fit: double>>")
    assert [len(r.s) for r in df.select(S.segments(F.col("v")).alias("s")).collect()] == [0, 0]


def series(spark, values, start=1990):
    return spark.createDataFrame([(1, start + i, dt.datetime(start + i, 6, 1), v) for i, v in enumerate(values)], "px int, yr int, t timestamp, v double")


def test_spike_is_replaced(spark):
    out = X.despike(series(spark, [0.5, 0.5, 0.9, 0.5, 0.5]), "v", 0.1, ["v"], ["px"], ["yr"]).orderBy("yr")
    assert [r.v for r in out.collect()] == [0.5] * 5


def test_spike_beside_a_gap_stays(spark):
    out = X.despike(series(spark, [0.5, None, 0.9, 0.5, 0.5]), "v", 0.1, ["v"], ["px"], ["yr"]).orderBy("yr")
    assert [r.v for r in out.collect()] == [0.5, None, 0.9, 0.5, 0.5]


def test_gap_is_interpolated(spark):
    rows = [(1, dt.datetime(2000, 1, 1) + dt.timedelta(days=10 * i), v) for i, v in enumerate([0.2, None, None, 0.8])]
    df = spark.createDataFrame(rows, "px int, t timestamp, v double")
    out = X.linear_interpolation(df, ["v"], ["px"]).orderBy("t")
    assert [round(r.v, 9) for r in out.collect()] == [0.2, 0.4, 0.6, 0.8]
    far = X.linear_interpolation(df, ["v"], ["px"], days=5).orderBy("t")
    assert [r.v for r in far.collect()] == [0.2, None, None, 0.8]


def test_weights_need_a_full_window(spark):
    with pytest.raises(ValueError):
        P.year_windows(spark, 1990, 2000, 1, [1, 2])
    assert P.year_windows(spark, 1990, 1994, 1, [1, 5, 1]).agg(F.sum("weight")).first()[0] == 21


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(a), float(b), float(2 * a - b + k + rng.normal() / 10)) for k in range(3) for a, b in rng.normal(size=(20, 2))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    for r in R.multiple_regression(df, ["y"], {"a": F.col("a"), "b": F.col("b")}, ["k"]).collect():
        own = np.array([x[1:] for x in rows if x[0] == r.k])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[:, :2]]), own[:, 2], rcond=None)[0]
        assert np.allclose([r.y_intercept, r.y_a, r.y_b], want)
    flat = spark.createDataFrame([(1, 1.0, 1.0, 2.0)] * 3, df.schema)
    assert R.multiple_regression(flat, ["y"], {"a": F.col("a")}, ["k"]).first().y_a is None


@pytest.mark.parametrize(("values", "corners"), [([0.0] * 8 + [1.0] * 8, 2), ([0.5] * 16, 0), (list(np.linspace(0, 1, 16)), 0), ([0.0] * 5 + [1.0] + [1 - 0.1 * i for i in range(1, 10)], 2)])
def test_segmentation_of_known_shapes(values, corners):
    years = np.arange(1990, 1990 + len(values))
    t, fit, corner, rmse = M.segmentation(years, np.array(values, float), M.SEGMENTATION)
    assert corner.sum() - 2 == pytest.approx(corners, abs=1)
    assert rmse < 0.16 and len(fit) == len(values)


def test_segmentation_needs_observations():
    assert M.segmentation(np.arange(5), np.ones(5), M.SEGMENTATION) is None
    v = np.ones(10)
    v[:6] = np.nan
    assert M.segmentation(np.arange(10), v, M.SEGMENTATION) is None


def test_f_tail():
    assert M.f_test(1.0, 5, 5) == pytest.approx(0.5, abs=1e-9)
    assert M.f_test(4.0, 1, 10) == pytest.approx(0.07339, abs=1e-4)


def test_landtrendr_on_spark(spark):
    df = series(spark, [0.8] * 8 + [0.3] * 8)
    lt = M.landtrendr(df, "v", ["px"], direction=-1).first()
    years = [p.yr for p in lt.lt if p.is_vertex]
    assert {1997, 1998} & set(years) and lt.rmse < 0.1


def test_curvature_penalty_keeps_lines():
    y = np.linspace(0, 1, 12)
    assert np.allclose(M.curvature_penalised(y, 0.1, 1e-6), y, atol=1e-6)
    step = np.r_[np.zeros(6), np.ones(6)]
    assert M.curvature_penalised(step, 0.1, 1e-6).ptp() > 0.5 if hasattr(step, "ptp") else np.ptp(M.curvature_penalised(step, 0.1, 1e-6)) > 0.5


def test_continuous_change_finds_the_break():
    t = np.arange(2000, 2008, 1 / 12)
    v = 0.5 + 0.1 * np.cos(2 * np.pi * t) + np.random.default_rng(0).normal(0, 0.01, len(t))
    v[t >= 2004] -= 0.25
    segs = M.continuous_change(t, v[:, None])
    assert len(segs) == 2 and segs[0]["tBreak"] == pytest.approx(2004, abs=0.1) and segs[0]["mag"] == pytest.approx(-0.25, abs=0.05)
    assert len(M.continuous_change(t[t < 2004], v[t < 2004][:, None])) == 1


def test_superpixels_follow_an_edge():
    rows, cols = (x.ravel() for x in np.mgrid[0:10, 0:10])
    v = (cols >= 5).astype(float)[:, None] * 10
    got = M.superpixels(rows, cols, v, 5, 0.1)
    assert (got >= 0).all() and not set(got[cols < 5]) & set(got[cols >= 5])


def dated(spark, *days):
    rows = [(1, dt.datetime(y, 1, 1) + dt.timedelta(days=doy - 1), v) for y, doy, v in days]
    return spark.createDataFrame(rows, "px int, t timestamp_ntz, v double")


def test_a_wrapped_season_holds_its_winter(spark):
    df = dated(spark, (2000, 300, 1.0), (2001, 20, 3.0), (2001, 300, 10.0), (2001, 200, 99.0))
    out = P.time_series(df, ["v"], (2000, 2001), (274, 120), reducer=F.avg)
    assert {r.year: (r.v, r.compositeObsCount) for r in out.collect()} == {2001: (2.0, 2), 2002: (10.0, 1)}


def test_a_wrapped_season_is_dated_to_the_year_with_more_days(spark):
    df = dated(spark, (2000, 320, 1.0), (2001, 20, 3.0))
    out = P.time_series(df, ["v"], (2000, 2000), (300, 60), reducer=F.avg).collect()
    assert [(r.year, r.v) for r in out] == [(2000, 2.0)]


def test_the_end_of_a_wrapped_season_after_a_leap_year(spark):
    df = dated(spark, (2001, 119, 1.0), (2001, 120, 5.0), (2002, 120, 7.0))  # 2000 has 366 days
    out = P.time_series(df, ["v"], (2000, 2001), (274, 120), reducer=F.avg)
    assert {r.year: r.v for r in out.collect()} == {2001: 1.0, 2002: 7.0}


def test_an_uncertain_largest_loss_is_no_loss(spark):
    from rastertime.functions import ccdc as C

    seg = "px int, segs array<struct<tStart: double, tEnd: double, tBreak: double, changeProb: double, mag: double>>"
    df = spark.createDataFrame([(1, [(1990.0, 1995.0, 1995.5, 1.0, -0.1), (1996.0, 1998.0, 1998.5, 0.5, -0.4), (1999.0, 2003.0, 2003.5, 1.0, 0.2)])], seg)
    r = df.select(*[c.alias(n) for n, c in C.changes(F.col("segs")).items()]).first()
    assert (r.largest_loss_year, r.largest_loss_mag, r.newest_loss_year) == (None, None, None)
    assert (r.largest_gain_year, r.newest_gain_mag) == (2003.5, 0.2)


def test_a_tolerance_under_a_second(spark):
    from rastertime.operators import joins as J

    a = dated(spark, (2000, 10, 1.0), (2000, 11, 2.0))
    got = J.nearest_in_time(a, a, ["px"], 0.0, ["px", "t"], ["t"]).collect()
    assert sorted((r.v, r.v_2) for r in got) == [(1.0, 1.0), (2.0, 2.0)]


def test_series_that_are_too_short_drop_out(spark):
    full = [(1, y, 0.1 * y % 0.3) for y in range(1995, 2002)]
    rows = spark.createDataFrame([*full, (2, 1995, 0.5), (2, 1996, None), (3, 1995, float("nan")), *[(3, y, 0.2) for y in range(1996, 2002)], *[(2**60 + 1, y, 0.4) for _, y, _ in full], *[(None, y, 0.4) for _, y, _ in full]], "px long, yr int, v double")
    got = {r.px: r for r in M.verdet(rows, "v", ["px"], (1995, 2001)).collect()}
    assert set(got) == {1, 2**60 + 1, None} and len(got[1].slopes) == 6
    assert [v.yr for v in got[None].vertices] == [1995, 2001]
    assert {r.px for r in M.landtrendr(rows, "v", ["px"]).collect()} == {1, 3, 2**60 + 1, None}
    assert M.ccdc(rows.where("v IS NULL").withColumn("t", F.col("yr").cast("double")), ["v"], ["px"], t="t").count() == 0
