"""Control charts of a pixel's residuals from its harmonic fit, in column expressions over the pixel's own series.

A series is one array, as it is short (tens to hundreds of observations), made by one shuffle. Fits sum the normal
equations over the array and eliminate by rows, so any number of harmonics does. Arrays are paired with repeated
coefficients instead of naming these within a lambda, which would work them out again for every observation.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl


def wave(t: Column, harmonics: int) -> Column:
    """1, then cosine and sine of each harmonic of a decimal year."""
    return F.array(dbl(1), *[f(t * dbl(2 * pi * h)) for h in range(1, harmonics + 1) for f in (F.cos, F.sin)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), dbl(0), lambda s, x: s + x)


def solved(matrix: Column, p: int) -> Column:
    """The solution of p equations given as rows of p coefficients and a right side; NULLs where they have no single one."""

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        scaled = F.transform(pivot, lambda x: F.try_divide(x, F.get(pivot, k)))
        return F.zip_with(m, F.sequence(F.lit(0), F.lit(p - 1)), lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda a, b: a - F.get(row, k) * b)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), matrix, step), lambda row: F.get(row, F.lit(p)))


def fitted(observations: Column, p: int) -> Column:
    """Least-squares coefficients of observations (x, v), x an array of p numbers."""
    outer = lambda e: F.flatten(F.transform(e["x"], lambda a: F.concat(F.transform(e["x"], lambda b: a * b), F.array(a * e["v"]))))
    zero = F.array_repeat(dbl(0), p * (p + 1))
    sums = F.aggregate(observations, zero, lambda s, e: F.zip_with(s, outer(e), lambda a, b: a + b))
    return solved(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.slice(sums, i * (p + 1) + 1, F.lit(p + 1))), p)


def deviation(values: Column) -> Column:
    """The sample standard deviation of an array; NULL for fewer than two."""
    n = F.size(values).cast("double")
    moments = F.aggregate(values, F.struct(dbl(0).alias("s"), dbl(0).alias("m"), dbl(0).alias("n")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"]) * a["n"] / (a["n"] + 1)).alias("s"), (a["m"] + (x - a["m"]) / (a["n"] + 1)).alias("m"), (a["n"] + 1).alias("n")))
    return F.when(n > 1, F.sqrt(moments["s"] / (n - 1)))


def ewmacd(df: DataFrame, band: str, keys: list[str], train: tuple[int, int], harmonics: int = 1, t: str = "t_dec", least: float = -1.0, weight: float = 0.3, width: float = 3.0) -> DataFrame:
    """(keys, t, ewma) for observations above ``least``, the vegetation threshold; t is a decimal year.

    Residuals from the training years' harmonic fit, which is made again without those beyond three deviations, are averaged
    with weights that fall by time; ewma counts the whole control limits that the average is away. NULL for pixels with too few
    observations in training; without any spread 0. Observations of one time go by value.
    """
    p = 2 * harmonics + 1
    rows = df.where(F.col(band).isNotNull() & F.col(t).isNotNull() & (F.col(band) > least))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(band).cast("double").alias("v")))).alias("_s"))
    rows = rows.withColumn("_o", F.transform("_s", lambda e: F.struct(wave(e["t"], harmonics).alias("x"), e["v"].alias("v"), ((e["t"] >= train[0]) & (e["t"] < train[1] + 1)).alias("own"))))
    own = lambda e: e["own"]
    rows = rows.withColumn("_known", F.size(F.filter("_o", own)) >= p + 2)
    for again in (True, False):
        rows = rows.withColumn("_b", F.when(F.col("_known"), fitted(F.filter("_o", own), p)))
        rows = rows.withColumn("_r", F.zip_with("_o", F.array_repeat("_b", F.size("_o")), lambda e, b: F.struct((e["v"] - dot(e["x"], b)).alias("r"), e["own"].alias("own"))))
        rows = rows.withColumn("_sd", deviation(F.transform(F.filter("_r", own), lambda e: e["r"])))
        if again:
            bound = F.array_repeat(F.col("_sd") * 3, F.size("_o"))
            within = F.zip_with("_r", bound, lambda e, b: e["own"] & (F.abs(e["r"]) <= b))
            rows = rows.withColumn("_o", F.zip_with("_o", within, lambda e, w: F.struct(e["x"].alias("x"), e["v"].alias("v"), F.coalesce(w, F.lit(False)).alias("own"))))
    keep = dbl(1 - weight)

    def add(a: Column, e: Column) -> Column:
        z = a["z"] * keep + e["r"] * dbl(weight)
        return F.struct(z.alias("z"), F.concat(a["all"], F.array(z)).alias("all"))

    z = F.aggregate("_r", F.struct(dbl(0).alias("z"), F.array().cast("array<double>").alias("all")), add, lambda a: a["all"])
    rows = rows.withColumn("_z", z)
    limit = lambda i: dbl(width) * F.sqrt(dbl(weight / (2 - weight)) * (dbl(1) - F.pow(keep, (i + 1) * 2)))
    limits = F.zip_with(F.transform(F.sequence(F.lit(0), F.size("_z") - 1), limit), F.array_repeat("_sd", F.size("_z")), lambda a, sd: a * sd)
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
    chart = F.zip_with("_z", limits, lambda x, b: F.when(b > 0, whole(x / b)).when(b == 0, dbl(0)))
    out = rows.select(*keys, F.explode(F.arrays_zip(F.transform("_s", lambda e: e["t"]).alias("t"), chart.alias("ewma"))).alias("e"))
    return out.select(*keys, F.col("e.t").alias(t), F.col("e.ewma").alias("ewma"))


def annual_ewma(chart: DataFrame, keys: list[str], t: str = "t_dec", reducer=F.min) -> DataFrame:
    return chart.groupBy(*keys, F.floor(t).cast("int").alias("yr")).agg(reducer("ewma").alias("ewma"))
