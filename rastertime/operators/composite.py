"""Temporal composites: one row per pixel and window. All of them shuffle once, by pixel and window."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import pow

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl
from rastertime.functions.dates import window_year, wrap_dates

#: Bands whose distance to their medians a medoid minimises.
MEDOID_BANDS = ["green", "red", "nir", "swir1", "swir2"]
TIES = ["t", "ok", "ln", "pk"]


def daily_mosaic(df: DataFrame, bands: list[str], keys: list[str], ties: list[str] = TIES) -> DataFrame:
    """Per pixel, day and orbit: each band's last valid value."""
    order = F.struct(*ties)
    return df.groupBy(*keys, F.to_date("t").alias("date")).agg(*[F.max_by(F.col(b), F.when(F.col(b).isNotNull(), order)).alias(b) for b in bands])


def year_windows(spark: SparkSession, first: int, last: int, buffer: int = 0, weights: list[int] | None = None) -> DataFrame:
    """(year, member, weight): the years that a composite draws on and how often each counts."""
    weights = weights or [1] * (2 * buffer + 1)
    if len(weights) != 2 * buffer + 1:
        raise ValueError("one weight per year of the window is needed")
    rows = [(y, y + k - buffer, w) for y in range(first + buffer, last - buffer + 1) for k, w in enumerate(weights)]
    return spark.createDataFrame(rows, "year int, member int, weight int")


def in_windows(df: DataFrame, windows: DataFrame, by: str = "yr") -> DataFrame:
    """Each observation once per window and unit of weight. Windows are a row per year and weight, so they are broadcast."""
    met = df.join(F.broadcast(windows), F.col(by) == F.col("member"))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), "weight"))).drop("member", "weight")


def reduce_bands(df: DataFrame, bands: list[str], keys: list[str], reducer: Callable[[Column], Column] = F.median) -> DataFrame:
    """Any aggregate of each band, and how many valid observations there were."""
    return df.groupBy(*keys).agg(*[reducer(F.col(b)).alias(b) for b in bands], F.count(bands[0]).alias("compositeObsCount"))


def _squares(*off: Column) -> Column:
    """Sum of squares by the C library's pow, as other engines have it: it rounds some squares unlike a product or the JVM's pow."""

    def run(*columns: pd.Series) -> pd.Series:
        square = [pd.Series([pow(x, 2.0) if abs(x) < 1e150 else x * x for x in c.astype(float)], dtype="float64") for c in columns]
        return reduce(lambda a, b: a + b, square)  # in order, rounded at each step

    return F.pandas_udf(run, "double")(*off)


def medoid(df: DataFrame, bands: list[str], keys: list[str], near: list[str] = MEDOID_BANDS, ties: list[str] = TIES) -> DataFrame:
    """The whole observation nearest to the medians of ``near``; ties go to the earliest. Adds its date.

    Medians and the least distance are window expressions and the choice an aggregate over the same keys, so the rows are
    shuffled once. Two observations are as far from their medians but for rounding, so the last bit decides: the rows
    that are nearest but for some bits, hardly more than one a composite, are compared by ``_squares``.
    """
    over = Window.partitionBy(*keys)
    rows = df.withColumns({f"_m_{b}": F.median(b).over(over) for b in near})
    off = [F.col(b) - F.col(f"_m_{b}") for b in near]
    rows = rows.withColumn("_far", reduce(lambda a, b: a + b, [d * d for d in off]))
    rows = rows.withColumns({"_n": F.count("_far").over(over), "_least": F.min("_far").over(over)})
    rows = rows.where((F.col("_far") <= F.col("_least") * dbl(1 + 1e-12)) | F.col("_least").isNull())
    rows = rows.withColumn("_far", F.when(F.col("_far").isNotNull(), _squares(*off)))
    best = F.min_by(F.struct(*bands, "t"), F.when(F.col("_far").isNotNull(), F.struct("_far", *ties)))
    out = rows.groupBy(*keys).agg(best.alias("_b"), F.first("_n").alias("compositeObsCount"))
    out = out.select(*keys, *[F.col(f"_b.{b}").alias(b) for b in bands], "compositeObsCount", F.col("_b.t").alias("t"))
    return out.withColumns({"obs_year": F.year("t"), "julianDay": F.dayofyear("t")})


def time_series(df: DataFrame, bands: list[str], years: tuple[int, int], days: tuple[int, int], buffer: int = 0, weights: list[int] | None = None, method: str = "medoid", reducer: Callable | None = None, px: str = "px") -> DataFrame:
    """Annual composites of a season over moving, weighted windows of years.

    A season that wraps over New Year belongs to the year in which it begins, whatever the calendar year of a day in it;
    its composite is dated to the year with more of its days. ``years`` are those in which seasons begin.
    """
    season = df.withColumn("_season", window_year(F.col("t"), *days)).where(F.col("_season").between(*years))
    windows = year_windows(df.sparkSession, *years, buffer, weights).withColumn("year", F.col("year") + wrap_dates(*days)[1])
    rows = in_windows(season, windows, "_season").drop("_season")
    if reducer is not None:
        return reduce_bands(rows, bands, [px, "year"], reducer)
    return reduce_bands(rows, bands, [px, "year"]) if method == "median" else medoid(rows, bands, [px, "year"])


def n_day(df: DataFrame, bands: list[str], days: tuple[int, int], period: int, px: str = "px") -> DataFrame:
    """Medians of each period of ``period`` days from the season's first day on, within each year."""
    first, last = days
    start = F.floor((F.col("doy") - first) / period) * period + first
    rows = df.where(F.col("doy") >= first).withColumn("start", start.cast("int")).where(F.col("start") <= last)
    return reduce_bands(rows, bands, [px, "yr", "start"])


def quality_mosaic(df: DataFrame, bands: list[str], keys: list[str], quality: Column, ties: list[str] = TIES) -> DataFrame:
    """All bands of the observation with the highest quality; ties go to the earliest."""
    rows = df.withColumn("_q", -quality)
    best = F.min_by(F.struct(*bands), F.when(F.col("_q").isNotNull(), F.struct("_q", *ties)))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def percentile_mosaic(df: DataFrame, bands: list[str], keys: list[str], band: str, percentile: float) -> DataFrame:
    """All bands of the observation nearest to a percentile of one band."""
    rows = df.withColumn("_p", F.percentile(band, percentile / 100).over(Window.partitionBy(*keys)))
    return quality_mosaic(rows, bands, keys, -F.round(F.abs(F.col(band) - F.col("_p")), 12))


def absolute_difference(df: DataFrame, keys: list[str], band: str, percentile: float, sign: int = -1) -> DataFrame:
    """Adds delta, the signed distance to a percentile of the band."""
    p = F.percentile(band, percentile / 100).over(Window.partitionBy(*keys))
    return df.withColumn("delta", F.abs(F.col(band) - p) * sign)


def composite_dates(df: DataFrame, composite: DataFrame, bands: list[str], keys: list[str], ties: list[str] = TIES) -> DataFrame:
    """For each band, the day of year of the observation nearest to the composite's value."""
    names = {b: f"_c_{b}" for b in bands}
    rows = df.join(composite.select(*keys, *[F.col(b).alias(n) for b, n in names.items()]), keys)
    gap = {b: F.round(F.abs(F.col(b) - F.col(n)), 12) for b, n in names.items()}  # two neighbours of a median tie
    return rows.groupBy(*keys).agg(*[F.min_by("doy", F.when(g.isNotNull(), F.struct(g, *ties))).alias(f"{b}_doy") for b, g in gap.items()])


def to_bands(df: DataFrame, label: str, values: list, band: str, px: str = "px") -> DataFrame:
    """Collection to columns, with the labels given, so no pass is needed to find them."""
    return df.groupBy(px).pivot(label, values).agg(F.first(band, ignorenulls=True))


def annual_median(df: DataFrame, bands: list[str], years: tuple[int, int], px: str = "px") -> DataFrame:
    return df.where(F.col("yr").between(*years)).groupBy(px, "yr").agg(*[F.median(b).alias(b) for b in bands])
