"""Per-pixel regression: linear trends, harmonics, their phase, amplitude, peak and area, and predictions."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl


def linear_fit(df: DataFrame, bands: list[str], keys: list[str], x: Column, centre: float = 0.0) -> DataFrame:
    """Slope and intercept (at x = ``centre``) of each band; centring keeps the sums well conditioned."""
    x = x - dbl(centre)
    return df.groupBy(*keys).agg(*[e for b in bands for e in (F.regr_slope(F.col(b), x).alias(f"{b}_slope"), F.regr_intercept(F.col(b), x).alias(f"{b}_intercept"))])


def linear_predict(df: DataFrame, model: DataFrame, bands: list[str], keys: list[str], x: Column, centre: float = 0.0) -> DataFrame:
    return df.join(model, keys).withColumns({f"{b}_trend": F.col(f"{b}_slope") * (x - dbl(centre)) + F.col(f"{b}_intercept") for b in bands})


def r_squared(df: DataFrame, observed: str, predicted: str, keys: list[str]) -> DataFrame:
    """1 - SSE / SST over rows where both are valid."""
    both = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull())
    sse = F.sum(F.pow(F.col(observed) - F.col(predicted), dbl(2)))
    sst = F.var_pop(observed) * F.count(observed)
    return both.groupBy(*keys).agg((dbl(1) - F.try_divide(sse, sst)).alias("r2"))


def harmonics(t: Column, which: tuple[int, ...] = (2,)) -> dict[str, Column]:
    """sin and cos of h pi t; h = 2 is one cycle a year."""
    out = {}
    for h in which:
        out |= {f"sin_{h * 100}_year": F.sin(t * dbl(h * pi)), f"cos_{h * 100}_year": F.cos(t * dbl(h * pi))}
    return out


def multiple_regression(df: DataFrame, bands: list[str], predictors: dict[str, Column], keys: list[str]) -> DataFrame:
    """Ordinary least squares of each band on an intercept and the predictors.

    Spark sums the cross products (k (k + 3) / 2 of them per band, before the shuffle); the small systems are then
    solved in Arrow batches, all rows of a batch at once. Singular systems give NULLs.
    """
    names = ["intercept", *predictors]
    k = len(names)
    df = df.withColumns({"_p0": dbl(1)} | {f"_p{i + 1}": c for i, c in enumerate(predictors.values())})
    sums = []
    for j, b in enumerate(bands):
        ok = F.col(b).isNotNull()
        p = [F.when(ok, F.col(f"_p{i}")) for i in range(k)]
        sums += [F.sum(p[i] * p[m]).alias(f"_{j}_{i}_{m}") for i in range(k) for m in range(i, k)]
        sums += [F.sum(p[i] * F.col(b)).alias(f"_{j}_{i}") for i in range(k)]
    rows = df.groupBy(*keys).agg(*sums)
    out = [f"{b}_{n}" for b in bands for n in names]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pdf[keys].copy()
            for j, b in enumerate(bands):
                a = np.empty((len(pdf), k, k))
                for i in range(k):
                    for m in range(i, k):
                        a[:, i, m] = a[:, m, i] = pdf[f"_{j}_{i}_{m}"]
                y = np.stack([pdf[f"_{j}_{i}"].to_numpy(float) for i in range(k)], axis=1)
                good = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(y).all(axis=1)
                good[good] = np.linalg.matrix_rank(a[good]) == k if good.any() else good[good]
                x = np.full((len(pdf), k), np.nan)
                if good.any():
                    x[good] = np.linalg.solve(a[good], y[good][:, :, None])[:, :, 0]
                for i, n in enumerate(names):
                    made[f"{b}_{n}"] = pd.Series(x[:, i], index=pdf.index).astype(object).where(good, None)
            yield made

    return rows.mapInPandas(solve, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema] + [f"`{o}` double" for o in out]))


def harmonic_fit(df: DataFrame, bands: list[str], keys: list[str], t: Column, which: tuple[int, ...] = (2,), detrend: bool = False) -> DataFrame:
    trend = {"year": t} if detrend else {}
    return multiple_regression(df, bands, trend | harmonics(t, which), keys)


def harmonic_value(band: str, t: Column, which: tuple[int, ...] = (2,), detrend: bool = False) -> Column:
    """The fitted curve of a row that has the coefficients, at time t."""
    out = F.col(f"{band}_intercept")
    if detrend:
        out = out + F.col(f"{band}_year") * t
    for name, c in harmonics(t, which).items():
        out = out + F.col(f"{band}_{name}") * c
    return out


def phase(band: str) -> Column:
    """0 to 1."""
    return (F.atan2(F.col(f"{band}_sin_200_year"), F.col(f"{band}_cos_200_year")) + dbl(pi)) / dbl(2 * pi)


def amplitude(band: str) -> Column:
    """Peak to trough."""
    return dbl(2) * F.hypot(F.col(f"{band}_sin_200_year"), F.col(f"{band}_cos_200_year"))


def peak(band: str, direction: int = 1) -> Column:
    """Fraction of the year at which the annual curve is highest (lowest for direction -1)."""
    at = F.atan2(F.col(f"{band}_sin_200_year") * direction, F.col(f"{band}_cos_200_year") * direction) / dbl(2 * pi)
    return F.when(at < 0, at + dbl(1)).otherwise(at)


def area(band: str, start: float = 0.0, end: float = 1.0) -> Column:
    """Integral of the annual curve with its amplitude as the level."""
    s, c, w = F.col(f"{band}_sin_200_year"), F.col(f"{band}_cos_200_year"), 2 * pi
    wave = c * (F.sin(dbl(w * end)) - F.sin(dbl(w * start))) - s * (F.cos(dbl(w * end)) - F.cos(dbl(w * start)))
    return F.hypot(s, c) * dbl(end - start) + wave / dbl(w)


def phase_amplitude_peak(df: DataFrame, bands: list[str], start: float = 0.0, end: float = 1.0) -> DataFrame:
    return df.withColumns({f"{b}_{n}": c for b in bands for n, c in (("amplitude", amplitude(b)), ("phase", phase(b)), ("peak", peak(b)), ("auc", area(b, start, end)))})
