"""Masks that need an observation's pixel history: cloud-score offsets and dark-outlier shadows."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl, mask
from rastertime.operators.focal import contract_dilate, focal_max, focal_min


def with_margin(df: DataFrame, clear: Column, contract: float, dilate: float, image: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds keep: within each image clear cells first grow by ``contract`` cells, then shrink by ``dilate``.

    Specks go and larger masked areas get a margin. Cells where ``clear`` is NULL are seen by nobody and stay masked; a
    cell with several rows in an image is clear if any of them is. Only keys and the mask are shuffled.
    """
    at = [*image, "row", "col"]
    rows = df.withColumn("_clear", clear.cast("int"))
    cells = rows.select(*at, "_clear").where(F.col("_clear").isNotNull())
    wide = contract_dilate(cells, "_clear", contract, dilate, list(image)).withColumnRenamed("_clear", "_wide")
    kept = F.col("_clear").isNotNull() & F.coalesce(F.col("_wide") == 1, F.lit(False))
    return rows.join(wide, at, "left").select(*df.columns, kept.alias("keep"))


def _masked(df: DataFrame, clear: Column, bands: list[str], contract: float, dilate: float, image: tuple[str, ...]) -> DataFrame:
    if not contract and not dilate:
        return mask(df, clear, bands)
    out = with_margin(df, clear, contract, dilate, image)
    return mask(out, F.col("keep"), bands).drop("keep")


def cloud_score_mask(df: DataFrame, score: Column, bands: list[str], threshold: float = 20, percentile: float = 10, offset: bool = True, stats: DataFrame | None = None, px: str = "px", contract: float = 0, dilate: float = 0, image: tuple[str, ...] = ("t",)) -> DataFrame:
    """Keeps observations whose score, less the pixel's own percentile of scores, is under the threshold.

    ``stats`` (px, score_offset) are precomputed percentiles; without them one shuffle by pixel gives them.
    ``contract`` and ``dilate`` give the mask of each image a margin.
    """
    df = df.withColumn("cloudScore", score)
    if not offset:
        own = F.lit(0)
    elif stats is not None:
        df, own = df.join(stats, px, "left"), F.coalesce("score_offset", F.lit(0))
    else:
        df = df.withColumn("score_offset", F.percentile("cloudScore", percentile / 100).over(Window.partitionBy(px)))
        own = F.col("score_offset")
    return _masked(df, F.col("cloudScore") - own < threshold, bands, contract, dilate, image)


def dark_outlier(z: float = -1, total: float = 0.35, bands: tuple[str, ...] = ("nir", "swir1")) -> Column:
    """True where all bands are far below their pixel's mean and dark in sum; needs {band}_mean and {band}_std."""
    low = reduce(lambda a, b: a & b, [F.try_divide(F.col(b) - F.col(f"{b}_mean"), F.col(f"{b}_std")) < dbl(z) for b in bands])
    return low & (reduce(lambda a, b: a + b, [F.col(b) for b in bands]) < dbl(total))


def shadow_mask(df: DataFrame, bands: list[str], z: float = -1, total: float = 0.35, dark: tuple[str, ...] = ("nir", "swir1"), stats: DataFrame | None = None, px: str = "px", contract: float = 0, dilate: float = 0, image: tuple[str, ...] = ("t",)) -> DataFrame:
    """Masks temporal dark outliers, with a margin in each image if asked for. ``stats`` (px, {band}_mean, {band}_std) may be precomputed."""
    names = [f"{b}_{s}" for b in dark for s in ("mean", "std")]
    if stats is None:
        over = Window.partitionBy(px)
        df = df.withColumns({f"{b}_mean": F.avg(b).over(over) for b in dark} | {f"{b}_std": F.stddev_pop(b).over(over) for b in dark})
    else:
        df = df.join(stats, px, "left")
    return _masked(df, ~F.coalesce(dark_outlier(z, total, dark), F.lit(False)), bands, contract, dilate, image).drop(*names)


def pixel_statistics(df: DataFrame, score: Column, dark: tuple[str, ...] = ("nir", "swir1"), percentile: float = 10, px: str = "px") -> DataFrame:
    """What the two masks above need, one row per pixel, to be kept as a table."""
    exprs = [F.percentile(score, percentile / 100).alias("score_offset")]
    exprs += [f(b).alias(f"{b}_{s}") for b in dark for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(px).agg(*exprs)


def shadows_projected(df: DataFrame, bands: list[str], image: list[str], cloud: Column, dark: Column, azimuth: Column, zenith: Column, heights: list[float], cell: float, contract: float = 1.5, dilate: float = 3.5) -> DataFrame:
    """Masks clouds and the shadows that they throw, and adds cloudShadowMask (1 in shadow); a row per cell of an image.

    Clouds and dark cells first lose specks (least within ``contract``) and grow again (largest within ``dilate``). Each cloud
    cell throws a shadow from every height, away from the sun of its image (degrees), on a cell of ``cell`` units; where that
    is dark and no cloud it is shadow, which then loses specks and grows likewise. Shadows are distinct cells, joined by place.
    """

    def opened(mask_: Column, name: str) -> DataFrame:
        rows = df.select(*image, "row", "col", F.coalesce(mask_.cast("int"), F.lit(0)).alias(name))
        return focal_max(focal_min(rows, name, contract, image), name, dilate, image)

    at = [*image, "row", "col"]
    both = opened(cloud, "_cloud").join(opened(dark, "_dark"), at)
    sun = df.select(*at, (F.radians(azimuth) + dbl(pi)).alias("_az"), F.tan(F.radians(zenith)).alias("_reach"))
    both = both.join(sun, at)
    away = lambda f, h: F.round(h * F.col("_reach") * f(F.col("_az")) / dbl(cell)).cast("long")
    shifts = F.array_distinct(F.transform(F.array(*[dbl(float(h)) for h in heights]), lambda h: F.struct(away(F.cos, h).alias("dr"), away(F.sin, h).alias("dc"))))
    thrown = both.where("_cloud = 1").select(*at, F.explode(shifts).alias("_s"))
    thrown = thrown.select(*image, (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col")).distinct()
    found = both.join(thrown.withColumn("_t", F.lit(1)), at, "left")
    shadow = found.select(*at, F.when(F.col("_t").isNotNull() & (F.col("_cloud") == 0), F.col("_dark")).otherwise(F.lit(0)).alias("cloudShadowMask"))
    shadow = focal_max(focal_min(shadow, "cloudShadowMask", contract, image), "cloudShadowMask", dilate, image)
    out = df.join(shadow, at).join(both.select(*at, "_cloud"), at)
    return mask(out, (F.col("cloudShadowMask") == 0) & (F.col("_cloud") == 0), bands).select(*df.columns, "cloudShadowMask")
