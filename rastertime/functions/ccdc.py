"""Continuous-change models: an array of segments {tStart, tEnd, tBreak, changeProb, coefs, mag} per pixel.

coefs are INTP, SLP, COS1, SIN1, COS2, SIN2, COS3, SIN3 of one band; times are decimal years.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl


def pick(segs: Column, t: Column, fill_gaps: bool = False) -> Column:
    """The segment with tStart < t <= tEnd, NULL if there is none; with ``fill_gaps`` a segment lasts to its break
    and the next begins there."""
    if fill_gaps:
        n = F.size(segs)

        def stretched(s: Column, i: Column) -> Column:
            before = F.get(segs, i - 1)["tBreak"]
            return F.struct(F.when(i == 0, s["tStart"]).otherwise(before).alias("lo"), F.when(i == n - 1, s["tEnd"]).otherwise(s["tBreak"]).alias("hi"), s.alias("s"))

        return F.get(F.filter(F.transform(segs, stretched), lambda x: (x["lo"] < t) & (t <= x["hi"])), F.lit(0))["s"]
    return F.get(F.filter(segs, lambda s: (s["tStart"] < t) & (t <= s["tEnd"])), F.lit(0))


def of_band(segs: Column, band: str) -> Column:
    """Segments of one band, from segments whose coefs and mag are maps by band."""
    return F.transform(segs, lambda s: s.withField("coefs", s["coefs"][band]).withField("mag", s["mag"][band]))


def value(coefs: Column, t: Column, harmonics: tuple[int, ...] = (1, 2, 3)) -> Column:
    out = F.get(coefs, F.lit(0)) + F.get(coefs, F.lit(1)) * t
    for h in harmonics:
        out = out + F.get(coefs, F.lit(2 * h)) * F.cos(t * dbl(2 * pi * h)) + F.get(coefs, F.lit(2 * h + 1)) * F.sin(t * dbl(2 * pi * h))
    return out


def time_series(first: int, last: int, step: float = 0.1, first_day: int = 1, last_day: int = 365) -> Column:
    """Decimal years from first to last by ``step``, those in a season only."""
    n = round((last + 1 - first) / step)
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: dbl(first) + i * dbl(step))
    return F.filter(times, lambda t: ((t - F.floor(t)) * 365 + 1).between(first_day, last_day + 1))


def predict(df: DataFrame, segs: str, times: Column, keys: list[str], fill_gaps: bool = False, harmonics: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row per pixel and time with the curve's value."""
    rows = df.select(*keys, segs, F.explode(times).alias("time"))
    return rows.select(*keys, "time", value(pick(F.col(segs), F.col("time"), fill_gaps)["coefs"], F.col("time"), harmonics).alias("predicted"))


def annualize(df: DataFrame, segs: str, first: int, last: int, keys: list[str], month: int = 9, day: int = 1, extrapolate: float = 0.0, fill_gaps: bool = True, harmonics: tuple[int, ...] = ()) -> DataFrame:
    """Value at one date of each year, with no harmonics or those given, and its difference from the year before (first year dropped)."""
    at = (dbl((month - 1) * 30.4375 + day - 1)) / dbl(365)
    n = F.size(segs)
    longer = F.transform(F.col(segs), lambda s, i: s.withField("tEnd", F.when(i == n - 1, s["tEnd"] + dbl(extrapolate)).otherwise(s["tEnd"])))
    rows = df.select(*keys, longer.alias("_s"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    t = F.col("year").cast("double") + at
    rows = rows.select(*keys, "year", value(pick(F.col("_s"), t, fill_gaps)["coefs"], t, harmonics).alias("fitted"))
    slope = F.col("fitted") - F.lag("fitted").over(Window.partitionBy(*keys).orderBy("year"))
    return rows.withColumn("fit_slope", slope).where(F.col("year") > first)


def annualize_at(df: DataFrame, segs: str, times: DataFrame, keys: list[str], fill_gaps: bool = True, harmonics: tuple[int, ...] = ()) -> DataFrame:
    """As ``annualize``, at a time of its own for each pixel and year: ``times`` (keys, year, time), such as the dates of composites.

    The first year of a pixel's times is dropped; a pixel without times has no row, one without a segment NULL values.
    """
    rows = times.select(*keys, "year", "time").join(df.select(*keys, segs), keys, "left")
    rows = rows.select(*keys, "year", "time", value(pick(F.col(segs), F.col("time"), fill_gaps)["coefs"], F.col("time"), harmonics).alias("fitted"))
    over = Window.partitionBy(*keys).orderBy("year")
    rows = rows.withColumns({"fit_slope": F.col("fitted") - F.lag("fitted").over(over), "_first": F.row_number().over(over) == 1})
    return rows.where("NOT _first").drop("_first")


def changes(segs: Column, probability: float = 1.0) -> dict[str, Column]:
    """Decimal year and magnitude of the newest and of the largest loss and gain; NULL where that break is uncertain.

    The newest and the largest are picked among all breaks, certain or not, so an uncertain one hides those behind it.
    """
    out = {}
    for kind, keep in (("loss", lambda s: s["mag"] < 0), ("gain", lambda s: s["mag"] > 0)):
        own = F.filter(segs, keep)
        for what, first in (("newest", lambda s: s["tBreak"]), ("largest", lambda s: F.abs(s["mag"]))):
            in_order = F.array_sort(F.transform(own, lambda s: F.struct(first(s).alias("by"), s["tBreak"].alias("k"), s["mag"].alias("mag"), s["changeProb"].alias("sure"))))  # noqa: B023
            top = F.get(F.reverse(in_order), F.lit(0))
            for name, field in (("year", "k"), ("mag", "mag")):
                out[f"{what}_{kind}_{name}"] = F.when(top["sure"] >= dbl(probability), top[field])
    return out


def annual_segments(df: DataFrame, segs: str, first: int, last: int, keys: list[str], day: int = 250) -> DataFrame:
    """A row per year with fit, slope and magnitude of the segment that spans it; of several the latest counts.

    A segment spans a year if it starts before ``day`` of that year and ends at or after that day of the year before.
    """
    rows = df.select(*keys, segs, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    now = F.col("year").cast("double") + dbl(day) / dbl(365)
    on = F.filter(F.col(segs), lambda s: (s["tStart"] < now) & (s["tEnd"] >= now - dbl(1)))
    s = F.get(F.reverse(on), F.lit(0))
    slope = F.get(s["coefs"], F.lit(1))
    fit = F.get(s["coefs"], F.lit(0)) + slope * now
    return rows.select(*keys, "year", fit.alias("fit"), slope.alias("slope"), (slope * (s["tEnd"] - s["tStart"])).alias("mag"))
