"""Relative radiometric normalisation: invariant cells, regression to a master, principal components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl


def covariance(df: DataFrame, bands: list[str]) -> DataFrame:
    """(band_a, band_b, cov) of every pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(bands) for b in bands[i:]]
    one = df.where(reduce(lambda x, y: x & y, [F.col(b).isNotNull() for b in bands])).agg(*[F.covar_pop(a, b).alias(f"{a}:{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("band_a"), F.lit(b).alias("band_b"), F.col(f"{a}:{b}").alias("cov")) for a, b in pairs])).alias("c")).select("c.*")


def principal_components(df: DataFrame, bands: list[str], n: int = 3) -> DataFrame:
    """Adds pc1 to pcn of unit variance. Means and a bands x bands matrix alone reach the driver; the largest loading of
    each component is positive."""
    cov = {(r.band_a, r.band_b): r.cov for r in covariance(df, bands).collect()}
    means = df.where(reduce(lambda x, y: x & y, [F.col(b).isNotNull() for b in bands])).agg(*[F.avg(b) for b in bands]).first()
    m = np.array([[cov.get((a, b), cov.get((b, a))) or 0.0 for b in bands] for a in bands])
    values, vectors = np.linalg.eigh(m)
    out = {}
    for k, i in enumerate(np.argsort(-values)[:n]):
        w = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i]) / np.sqrt(max(values[i], 1e-12))
        out[f"pc{k + 1}"] = reduce(lambda a, b: a + b, [(F.col(b) - dbl(mu or 0.0)) * dbl(x) for b, mu, x in zip(bands, means, w)])
    return df.withColumns(out)


def invariant(df: DataFrame, bands: list[str], z: float, every_band: bool = False, suffix: str = "_m") -> DataFrame:
    """Adds pif: whether the difference to the master lies within z deviations of its mean, in any band or in each."""
    diff = {b: F.col(b) - F.col(f"{b}{suffix}") for b in bands}
    stats = df.agg(*[e for b, d in diff.items() for e in (F.avg(d).alias(f"_a_{b}"), F.stddev_pop(d).alias(f"_s_{b}"))])
    rows = df.join(F.broadcast(stats))  # one row
    near = [F.coalesce(F.abs(d - F.col(f"_a_{b}")) <= F.col(f"_s_{b}") * z, F.lit(False)) for b, d in diff.items()]
    pif: Column = reduce((lambda x, y: x & y) if every_band else (lambda x, y: x | y), near)
    return rows.withColumn("pif", pif).drop(*stats.columns)


def normalize(df: DataFrame, bands: list[str], suffix: str = "_m") -> DataFrame:
    """Each band as regressed on all bands over invariant cells; needs pif and the master's bands.

    One aggregate gives the cross products; the k x k systems are solved on the driver.
    """
    k = len(bands) + 1
    x = [dbl(1), *[F.col(b) for b in bands]]
    ok = F.col("pif") & reduce(lambda a, b: a & b, [F.col(b).isNotNull() & F.col(f"{b}{suffix}").isNotNull() for b in bands])
    sums = [F.sum(x[i] * x[j]).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col(f"{b}{suffix}")).alias(f"{i}_{b}") for i in range(k) for b in bands]
    r = df.where(ok).agg(*sums).first()
    if r["0_0"] is None:
        return df.withColumns({f"{b}_norm": F.lit(None).cast("double") for b in bands})
    a = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    out = {}
    for b in bands:
        beta = np.linalg.lstsq(a, np.array([r[f"{i}_{b}"] for i in range(k)]), rcond=None)[0]
        out[f"{b}_norm"] = reduce(lambda p, q: p + q, [c * dbl(w) for c, w in zip(x, beta)])
    return df.withColumns(out)
