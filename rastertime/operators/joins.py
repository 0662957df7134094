"""Joins of observations: on equal keys, nearest in time, and nearest in time among overlapping footprints."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equi(a: DataFrame, b: DataFrame, on: list[str], suffix: str, mask_zero: bool = False) -> DataFrame:
    """Bands of both where the keys agree; with ``mask_zero``, only rows in which no band is exactly 0."""
    right = b.select(*on, *[F.col(c).alias(f"{c}{suffix}") for c in b.columns if c not in on])
    out = a.join(right, on)
    if mask_zero:
        bands = [c for c, kind in out.dtypes if kind == "double"]
        out = out.where(F.least(*[F.col(c) for c in bands]) != 0)
    return out


def bin_seconds(hours: float) -> int:
    """Width of the time bins for a tolerance: its whole seconds, one at least."""
    if hours < 0:
        raise ValueError("the tolerance can't be negative")
    return max(1, ceil(hours * 3600))


def nearest_in_time(primary: DataFrame, secondary: DataFrame, on: list[str], hours: float, key: list[str], ties: list[str], suffix: str = "_2", t: str = "t") -> DataFrame:
    """Each primary row with the secondary row of its group that is nearest in time, within ``hours``; others drop out.

    Time is cut into bins as wide as the tolerance. A secondary row is posted in its own bin and its two neighbours, so
    the range condition becomes an equi-join, and a group with a long history is spread over its bins.
    """
    width = bin_seconds(hours)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    left = primary.withColumn("_s", seconds(t)).withColumn("_bin", F.floor(F.col("_s") / width))
    right = secondary.select(*on, *[F.col(c).alias(f"{c}{suffix}") for c in secondary.columns if c not in on]).withColumn("_s2", seconds(f"{t}{suffix}"))
    here = F.floor(F.col("_s2") / width)
    right = right.withColumn("_bin", F.explode(F.array(here - 1, here, here + 1)))
    met = left.join(right, [*on, "_bin"]).withColumn("_gap", F.abs(F.col("_s") - F.col("_s2"))).where(F.col("_gap") <= hours * 3600)
    kept = [c for c in primary.columns if c not in key]
    found = [c for c in right.columns if c.endswith(suffix)]
    best = F.min_by(F.struct(*kept, *found, F.col("_gap").alias("gap_seconds")), F.struct("_gap", *[f"{c}{suffix}" for c in ties]))
    return met.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def spatio_temporal(primary: DataFrame, secondary: DataFrame, hours: float, key: list[str], ties: list[str], cell: float, suffix: str = "_2", t: str = "t") -> DataFrame:
    """Nearest in time among secondary rows whose boxes x0, x1, y0, y1 overlap the primary row's.

    Both sides are posted under the grid cells that their boxes touch and under time bins, which makes an equi-join.
    """
    width = bin_seconds(hours)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))

    def cells(df: DataFrame, s: str) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"{a}{s}") / cell), F.floor(F.col(f"{b}{s}") / cell)))
        return df.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1"))

    left = cells(primary, "").withColumn("_s", seconds(t)).withColumn("_bin", F.floor(F.col("_s") / width))
    right = cells(secondary.select(*[F.col(c).alias(f"{c}{suffix}") for c in secondary.columns]), suffix).withColumn("_s2", seconds(f"{t}{suffix}"))
    here = F.floor(F.col("_s2") / width)
    right = right.withColumn("_bin", F.explode(F.array(here - 1, here, here + 1)))
    sides = [{k: F.col(f"{k}{s}") for k in ("x0", "x1", "y0", "y1")} for s in ("", suffix)]
    met = left.join(right, ["_cx", "_cy", "_bin"]).where(overlap(*sides)).withColumn("_gap", F.abs(F.col("_s") - F.col("_s2"))).where(F.col("_gap") <= hours * 3600)
    found = [f"{c}{suffix}" for c in secondary.columns]
    kept = [c for c in primary.columns if c not in key]
    best = F.min_by(F.struct(*kept, *found, F.col("_gap").alias("gap_seconds")), F.struct("_gap", *[f"{c}{suffix}" for c in ties]))
    return met.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def features(primary: DataFrame, secondary: DataFrame, field: str, field2: str) -> DataFrame:
    """Properties of both; the secondary's win where names clash, the primary's geometry stays."""
    right = secondary.withColumnRenamed(field2, field) if field2 != field else secondary
    return primary.drop(*[c for c in right.columns if c != field]).join(right, field)


def missing_ids(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on), on, "left_anti")


def lookup(df: DataFrame, stats: DataFrame, on: list[str]) -> DataFrame:
    """Per-pixel statistics or masks; Spark broadcasts them if their size allows and else joins by pixel."""
    return df.join(stats, on, "left")


def by_time(parts: dict[str, DataFrame], on: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Bands of several products of one platform on equal keys; an ``optional`` product may be absent."""
    out = None
    for name, df in parts.items():
        out = df if out is None else out.join(df, on, "left" if name in optional else "inner")
    return out
