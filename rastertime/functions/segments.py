"""Piecewise-linear models as arrays of structs: vertices {yr, fit} to segments, losses and gains, annual values.

All expressions work within a row: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import NO_DATA, dbl

# Sort keys of the choices, as (field, descending).
CHOICES = {
    "loss": {"newest": ("yr", True), "oldest": ("yr", False), "largest": ("mag", False), "smallest": ("mag", True), "steepest": ("slope", False), "mostGradual": ("slope", True), "shortest": ("dur", False), "longest": ("dur", True)},
    "gain": {"newest": ("yr", True), "oldest": ("yr", False), "largest": ("mag", True), "smallest": ("mag", False), "steepest": ("slope", True), "mostGradual": ("slope", False), "shortest": ("dur", False), "longest": ("dur", True)},
}


def vertices(raw: Column) -> Column:
    """The vertices {yr, fit} of a raw model [{yr, raw, fit, is_vertex}]."""
    return F.transform(F.filter(raw, lambda p: p["is_vertex"]), lambda p: F.struct(p["yr"].alias("yr"), p["fit"].alias("fit")))


def scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda p: F.struct(p["yr"].alias("yr"), (p["fit"] * dbl(by)).alias("fit")))


def segments(v: Column) -> Column:
    """Pairs of neighbours: yr and fit of the right vertex, start of the left, dur, mag = left - right, slope = mag / dur."""
    n = F.greatest(F.size(v) - 1, F.lit(0))

    def pair(a: Column, b: Column) -> Column:
        dur, mag = b["yr"] - a["yr"], a["fit"] - b["fit"]
        return F.struct(
            b["yr"].cast("int").alias("yr"), dur.cast("int").alias("dur"), mag.alias("mag"), F.try_divide(mag, dur.cast("double")).alias("slope"),
            a["yr"].cast("int").alias("start"), a["fit"].alias("start_fit"), b["fit"].alias("end_fit"),
        )

    return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), pair)


def ranked(segs: Column, field: str, descending: bool) -> Column:
    """Sorted by one field, then by year."""
    sign = -1 if descending else 1

    def order(a: Column, b: Column) -> Column:
        x, y = a[field] * sign, b[field] * sign
        return F.when(x < y, -1).when(x > y, 1).when(a["yr"] < b["yr"], -1).when(a["yr"] > b["yr"], 1).otherwise(0)

    return F.array_sort(segs, order)


def loss_gain(v: Column, kind: str, choice: str = "largest", mag: float | None = None, slope: float | None = None) -> Column:
    """The losses or gains among the segments of vertices whose loss goes up, best first.

    A segment counts if it passes either threshold.
    """
    mag = (-0.15 if kind == "loss" else 0.1) if mag is None else mag
    slope = (-0.1 if kind == "loss" else 0.1) if slope is None else slope
    keep = (lambda s: (s["mag"] <= dbl(mag)) | (s["slope"] <= dbl(slope))) if kind == "loss" else (lambda s: (s["mag"] >= dbl(mag)) | (s["slope"] >= dbl(slope)))
    return ranked(F.filter(segments(v), keep), *CHOICES[kind][choice])


def top(segs: Column, n: int, prefix: str, fields: tuple[str, ...] = ("yr", "dur", "mag", "slope")) -> dict[str, Column]:
    """Wide columns {prefix}_{field}_{i}; NULL where there are fewer."""
    return {f"{prefix}_{f}_{i + 1}": F.get(segs, F.lit(i))[f] for i in range(n) for f in fields}


def disturbances(v: Column, loss1: float, loss20: float, n: int = 3) -> dict[str, Column]:
    """The ``n`` largest disturbances: first year, magnitude, duration and value before (loss goes up)."""
    segs = F.transform(segments(v), lambda s: F.struct((s["start"] + 1).alias("yr"), (-s["mag"]).alias("mag"), s["dur"].alias("dur"), (-s["start_fit"]).alias("preval")))
    segs = F.filter(segs, lambda s: (s["mag"] >= dbl(loss1)) | ((s["dur"] >= 15) & (s["mag"] >= dbl(loss20))))
    best = ranked(segs, "mag", True)
    return {f"{name}_{i + 1}": F.get(best, F.lit(i))[f] for i in range(n) for name, f in (("yod", "yr"), ("mag", "mag"), ("dur", "dur"), ("preval", "preval"))}


def padded(v: Column, n: int, no_data: int = NO_DATA) -> dict[str, Column]:
    """Wide columns yrs_i and fit_i with the sentinel where there are fewer vertices, for export."""
    out = {}
    for i in range(n):
        p = F.get(v, F.lit(i))
        out |= {f"yrs_{i + 1}": F.coalesce(p["yr"].cast("int"), F.lit(no_data)), f"fit_{i + 1}": F.coalesce(p["fit"], dbl(no_data))}
    return out


def from_padded(n: int, no_data: tuple[int, ...] = (NO_DATA, 32767, 0)) -> Column:
    pairs = F.array(*[F.struct(F.col(f"yrs_{i + 1}").alias("yr"), F.col(f"fit_{i + 1}").alias("fit")) for i in range(n)])
    return F.filter(pairs, lambda p: ~p["yr"].isin(*no_data))


def annual_from_segments(df: DataFrame, v: str, first: int, last: int, keys: list[str]) -> DataFrame:
    """A row per year in a segment: dur, fit, mag, slope and diff from the segment's left value.

    A year belongs to the segment that ends at or after it and begins before it; the first year also where it begins.
    """
    rows = df.select(*keys, F.explode(segments(F.col(v))).alias("s"))
    low = F.when(F.col("s.start") == first, F.col("s.start")).otherwise(F.col("s.start") + 1)
    lo, hi = F.greatest(low, F.lit(first)), F.least(F.col("s.yr"), F.lit(last))
    rows = rows.where(lo <= hi).withColumn("year", F.explode(F.sequence(lo, hi)))
    slope = F.try_divide(F.col("s.end_fit") - F.col("s.start_fit"), F.col("s.dur").cast("double"))
    fit = F.col("s.end_fit") - slope * (F.col("s.yr") - F.col("year")).cast("double")
    return rows.select(*keys, "year", F.col("s.dur").alias("dur"), fit.alias("fit"), (F.col("s.end_fit") - F.col("s.start_fit")).alias("mag"), slope.alias("slope"), (fit - F.col("s.start_fit")).alias("diff"))


def annual_many(df: DataFrame, stacks: dict[str, str], first: int, last: int, keys: list[str], prefix: str = "LT") -> DataFrame:
    """Annual segment values of several bands side by side: {band}_{prefix}_dur, fit, mag, slope and diff.

    ``stacks`` names each band's column of vertices. Years are assigned as in ``annual_from_segments``; a year in no
    band's segment has no row. All within a row: no join of bands and no shuffle.
    """
    rows = df.select(*keys, *[segments(F.col(v)).alias(f"_{b}") for b, v in stacks.items()])
    rows = rows.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    year = F.col("year")

    def here(b: str) -> Column:
        return F.get(F.filter(f"_{b}", lambda s: ((s["start"] < year) | ((s["start"] == first) & (year == first))) & (year <= s["yr"])), F.lit(0))

    def values(b: str) -> dict[str, Column]:
        s = F.col(f"_{b}")
        slope = F.try_divide(s["end_fit"] - s["start_fit"], s["dur"].cast("double"))
        fit = s["end_fit"] - slope * (s["yr"] - year).cast("double")
        return {"dur": s["dur"], "fit": fit, "mag": s["end_fit"] - s["start_fit"], "slope": slope, "diff": fit - s["start_fit"]}

    rows = rows.withColumns({f"_{b}": here(b) for b in stacks})
    rows = rows.where(F.coalesce(*[F.col(f"_{b}")["yr"] for b in stacks]).isNotNull())
    return rows.select(*keys, "year", *[c.alias(f"{b}_{prefix}_{n}") for b in stacks for n, c in values(b).items()])


def fitted(v: Column, year: Column) -> Column:
    """The model's value in a year between its first and last vertex; NULL outside."""
    on = F.filter(segments(v), lambda s: (s["start"] <= year) & (year <= s["yr"]))
    s = F.get(on, F.lit(0))
    return s["end_fit"] + s["slope"] * (s["yr"] - year).cast("double")


def annual_fit(df: DataFrame, v: str, first: int, last: int, keys: list[str]) -> DataFrame:
    rows = df.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.select(*keys, "year", fitted(F.col(v), F.col("year")).alias("fit"))


def array_to_series(df: DataFrame, values: str, years: str, possible: list[int], keys: list[str], name: str) -> DataFrame:
    """Parallel arrays to a row per possible year; of repeated years the last value counts."""
    table = F.aggregate(F.arrays_zip(F.col(years).alias("y"), F.col(values).alias("v")), F.expr("map_from_arrays(array(), array())").cast("map<int,double>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["y"]), F.create_map(p["y"], p["v"])))
    rows = df.withColumn("_t", table).withColumn("year", F.explode(F.array(*[F.lit(y) for y in possible])))
    return rows.select(*keys, "year", F.try_element_at("_t", F.col("year")).alias(name))


def stand_age(year: int, disturbed: Column, cover: Column, height: Column, least_height: float = 5, least_cover: float = 10, most: int = 20) -> Column:
    """Years since regrowth began where there is forest; the cap where it began before the record."""
    age = F.when(disturbed < year, F.least(F.lit(year) - disturbed, F.lit(most))).otherwise(F.lit(most))
    return F.when((cover >= least_cover) & (height >= least_height), F.coalesce(age, F.lit(most)))
