"""Charts of residuals against plain loops with numpy's least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertime.operators import charts as A
from rastertime.operators import models as M
from rastertime.plans import models as Q
from rastertime.sources.observations import observations
from tests.conftest import SF


def plain_chart(t, v, train, harmonics, weight=0.3, width=3.0):
    x = np.stack([np.ones_like(t)] + [f(2 * np.pi * h * t) for h in range(1, harmonics + 1) for f in (np.cos, np.sin)], axis=1)
    if train.sum() < x.shape[1] + 2:
        return [None] * len(t)
    for _ in range(2):
        r = v - x @ np.linalg.lstsq(x[train], v[train], rcond=None)[0]
        sd = r[train].std(ddof=1)
        train = train & (np.abs(r) <= 3 * sd)
    z, out = 0.0, []
    for i, e in enumerate(r):
        z = (1 - weight) * z + weight * e
        limit = width * sd * np.sqrt(weight / (2 - weight) * (1 - (1 - weight) ** (2 * (i + 1))))
        out.append(float(np.trunc(z / limit)) if limit > 0 else 0.0)
    return out


@pytest.mark.parametrize("harmonics", [1, 2, 3])
def test_charts(spark, harmonics):
    rng = np.random.default_rng(harmonics)
    rows, want = [], {}
    for px in range(5):
        t = np.sort(rng.uniform(2000, 2007, 90))
        v = 0.5 + 0.2 * np.cos(2 * np.pi * t) + 0.05 * np.sin(4 * np.pi * t) + rng.normal(0, 0.02, 90)
        v[t >= 2004 + px / 4] -= 0.3
        v[3] += 0.8  # left out of the second fit
        if px == 4:
            t = t + 3  # too few in training
        rows += [(px, float(a), float(b)) for a, b in zip(t, v)] + [(px, 2001.5, None), (px, 2001.6, -5.0)]
        want[px] = dict(zip(t.tolist(), plain_chart(t, v, (t >= 2000) & (t < 2003), harmonics)))
    df = spark.createDataFrame(rows, "px int, t_dec double, v double")
    out = A.ewmacd(df, "v", ["px"], (2000, 2002), harmonics)
    got = {}
    for r in out.collect():
        got.setdefault(r.px, {})[r.t_dec] = r.ewma
    assert got == want
    assert got[0][max(got[0])] < -3 and set(got[4].values()) == {None}


def test_flat_series_and_equations(spark):
    df = spark.createDataFrame([(1, 2000 + i / 10, 1.0) for i in range(40)], "px int, t_dec double, v double")
    assert {r.ewma for r in A.ewmacd(df, "v", ["px"], (2000, 2002)).collect()} == {0.0}
    m = np.random.default_rng(1).normal(size=(4, 4))
    m = m @ m.T + np.eye(4)
    y = np.arange(4.0)
    one = spark.createDataFrame([([[*map(float, r), float(b)] for r, b in zip(m, y)],)], "m array<array<double>>")
    assert np.allclose(one.select(A.solved(F.col("m"), 4).alias("x")).first().x, np.linalg.solve(m, y))


def test_annual_values_of_penalised_lines(spark):
    """Years of a pixel follow its vertices, line by line."""
    rows = Q.annual(observations(spark, SF))
    lines = {r.px: [(v.yr, v.fit) for v in r.vertices] for r in M.verdet(rows, "v", ["px"], (1995, 2001)).collect()}
    seen = 0
    for r in Q.verdet_annual(observations(spark, SF)).collect():
        v = lines[r.px]
        right = next(i for i, (y, _) in enumerate(v) if y >= r.year and i)
        (y0, f0), (y1, f1) = v[right - 1], v[right]
        assert r.NDVI_VT_dur == y1 - y0 and r.NDVI_VT_fit == pytest.approx(f0 + (f1 - f0) * (r.year - y0) / (y1 - y0), abs=1e-5)
        seen += 1
    assert seen == 7 * len(lines)


def test_annual_values_leave_out_pixels_without_a_year(spark):
    obs = observations(spark, SF)
    gone = obs.select("px").first().px
    got = {r.px for r in Q.verdet_annual(obs.where(~((F.col("px") == gone) & (F.col("yr") == 1998)))).select("px").distinct().collect()}
    assert got == {r.px for r in obs.select("px").distinct().collect()} - {gone}
