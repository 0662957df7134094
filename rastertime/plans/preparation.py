"""Scenes of a sensor family made ready for a recipe: every step from the catalogue's bands to one table, in its fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions import harmonize as H
from rastertime.functions import indices as I
from rastertime.functions.bands import all_band_mask, mask
from rastertime.functions.dates import in_days
from rastertime.operators import composite as P
from rastertime.operators import focal as L
from rastertime.operators.polygons import clip
from rastertime.plans.areas import HOLDS, areas
from rastertime.plans.registry import KEYS, KEYS_SQL, query, rounded
from rastertime.sources.catalog import merge
from rastertime.sources.observations import grid, observations, table

#: First and last day of the sensor with a scan-line corrector while that worked.
CORRECTED = ("1998-01-01", "2003-05-31")
FRINGED = ("L4", "L5")


@dataclass(frozen=True)
class Preparation:
    """What to take of the scenes. ``dates``: first and last day; ``days``: of the year, which may wrap; ``area``: polygons (rings)."""

    dates: tuple[str, str]
    days: tuple[int, int] = (1, 366)
    area: DataFrame | None = None
    tile: int = 64
    level: str = "SR"
    version: str = "C2"
    gaps: bool = False
    corrected: tuple[str, str] = CORRECTED
    defringe: bool = False
    kernel: dict | None = None
    least: float = L.FRINGE_LEAST
    quality: DataFrame | None = None
    index: tuple[str, ...] = ("index", "row", "col")
    image: tuple[str, ...] = ("index",)
    resample: str = "near"
    factor: int = 1
    daily: bool = True
    last_row: int = 120


def days_between(t: Column, first: str, last: str) -> Column:
    """Within whole days, the last included."""
    return (t >= F.lit(first).cast("timestamp_ntz")) & (t < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))


def chosen(df: DataFrame, p: Preparation) -> DataFrame:
    """Rows of the dates, days and area; date filters reach the scan, the area joins on tiles before any shuffle."""
    df = df.where(days_between(F.col("t"), *p.dates) & in_days(F.dayofyear("t"), *p.days))
    if "WRS_ROW" in df.columns:
        df = df.where(F.col("WRS_ROW") <= p.last_row)
    return df if p.area is None else clip(df, p.area, tile=p.tile)


def _calibrated(df: DataFrame, p: Preparation) -> DataFrame:
    """Surface reflectance by the version's factors; at the top of the atmosphere by each scene's {band}_gain, {band}_bias and sun_elevation."""
    if p.level == "SR":
        return H.apply_scale(df, p.version)
    if "sun_elevation" not in df.columns:
        return df
    made = {b: H.toa_reflectance(F.col(b), F.col(f"{b}_gain"), F.col(f"{b}_bias"), F.col("sun_elevation")) for b in I.SIX}
    return df.withColumns(made).drop(*[f"{b}_{x}" for b in I.SIX for x in ("gain", "bias")])


def _resampled(df: DataFrame, bands: list[str], p: Preparation) -> DataFrame:
    """Continuous bands as means of blocks of ``factor`` cells of an image, all other columns of the block's first cell."""
    if p.resample == "near" or p.factor == 1:
        return df
    if p.resample != "aggregate":
        raise ValueError("resample is near or aggregate; focal.bilinear and focal.bicubic sample at any point")
    block = {c: F.floor(F.col(c) / p.factor) for c in ("row", "col")}
    rest = [c for c in df.columns if c not in (*bands, *p.image, "row", "col")]
    rows = df.withColumns({"_first": F.struct(*[F.col(c).alias(f"_{c}") for c in ("row", "col")]), **block})
    out = rows.groupBy(*p.image, "row", "col").agg(*[F.avg(b).alias(b) for b in bands], *[F.min_by(c, "_first").alias(c) for c in rest])
    return out.select(*df.columns)


def landsat(parts: dict[str, DataFrame], p: Preparation) -> DataFrame:
    """One table from scenes by sensor (L4, L5, L7, L8, L9), with sensor.

    Dates, days, rows and area; calibration; fringes of the two oldest; the corrected days alone of L7 unless ``gaps``; L9
    in the second collection only; the union; quality bands joined by ``index``, which leaves scenes without any out; all bands
    valid or none; resampling.
    """
    ready = []
    for name, df in parts.items():
        if name == "L9" and p.version != "C2":
            continue
        df = _calibrated(chosen(df, p), p)
        if name == "L7" and not p.gaps:
            df = df.where(days_between(F.col("t"), *p.corrected))
        if p.defringe and name in FRINGED:
            valid = df.withColumn("_valid", F.greatest(*[F.col(b).isNull() for b in I.SIX]) == F.lit(False))
            df = L.defringe(valid, [*I.SIX, "temp"], "_valid", p.least, p.kernel or L.slanting(), list(p.image)).drop("_valid")
        ready.append(df.withColumn("sensor", F.lit(name)))
    out = merge(*ready)
    if p.quality is not None:
        out = out.join(p.quality, list(p.index))
    return _resampled(all_band_mask(out, I.SIX), [*I.SIX, "temp"], p)


def sentinel2(scenes: DataFrame, p: Preparation, bands: list[str], cloud_probability: DataFrame | None = None, cloud_score_plus: DataFrame | None = None) -> DataFrame:
    """Scenes (index, orbit, px, t, ...) with cloud bands joined by ``index``, resampled, as daily mosaics of an orbit, all bands valid or none.

    A scene without the asked cloud band drops out. The mask of all bands follows the mosaic, else seams of scenes stay.
    """
    df, names = chosen(scenes, p), list(bands)
    for extra, name in ((cloud_probability, "cloud_probability"), (cloud_score_plus, "cloudScorePlus")):
        if extra is not None:
            df = df.join(extra.select(*p.index, name), list(p.index))
            names.append(name)
    df = _resampled(df, bands, p)
    if p.daily:
        others = [c for c in df.columns if c not in ("px", "orbit", "t")]
        df = P.daily_mosaic(df, others, ["px", "orbit"]).withColumn("t", F.col("date").cast("timestamp_ntz"))
    return all_band_mask(df, bands)


def modis(platforms: dict[str, dict[str, DataFrame]], p: Preparation, zenith: float = 90, on: tuple[str, ...] = ("px", "t")) -> DataFrame:
    """Products of each platform (aqua, terra) joined by cell and time, with platform, and masked from a sun zenith on.

    Each platform's products: any names, each with the columns ``on``; all must be there for a row. SolarZenith, where a
    product brings it, is in hundredths of a degree.
    """
    ready = []
    for name, products in platforms.items():
        first, *more = [chosen(df, p) if "row" in df.columns else df for df in products.values()]
        for df in more:
            first = first.join(df, list(on))
        if "SolarZenith" in first.columns:
            bands = [c for c in first.columns if c in (*I.SIX, "temp")]
            first = mask(first, F.col("SolarZenith") < zenith * 100, bands)
        ready.append(first.withColumn("platform", F.lit(name)))
    return merge(*ready)


_CHOSEN = """ar AS (SELECT DISTINCT h.px FROM holds h JOIN grid a ON a.px = h.area WHERE a.zone % 2 = 0),
ch AS (SELECT *, CASE sensor WHEN 'A' THEN 'L5' WHEN 'R' THEN 'L7' ELSE 'L8' END AS sat FROM obs WHERE px IN (SELECT px FROM ar) AND t >= TIMESTAMP '1995-01-01' AND t < TIMESTAMP '1998-07-01' AND doy BETWEEN 100 AND 300)"""
#: Masked where the raw red is under 2 in a hundred, so that fringes exist.
_HOLE = "red * 100 >= 3"


def _raw(obs: DataFrame) -> DataFrame:
    number = {b: F.when(F.col("red") * 100 >= 3, F.floor(F.col(b) * 40000)) for b in I.SIX}
    return obs.withColumns(number)


@query(f"""WITH {HOLDS}, {_CHOSEN}, s AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {_HOLE} THEN floor({b} * 40000) * 0.0000275::DOUBLE + (-0.2)::DOUBLE END AS {b}" for b in I.SIX)}) FROM ch WHERE NOT (sat = 'L7' AND t >= TIMESTAMP '1997-01-01')),
c AS (SELECT yr, ln, row, col, max((red IS NOT NULL)::INTEGER) AS v FROM s WHERE sat = 'L5' GROUP BY ALL),
k AS (SELECT a.yr, a.ln, a.row, a.col, sum(b.v) AS n FROM c a, range(-2, 3) p(x), range(-2, 3) q(y) JOIN c b ON (x + y) % 2 = 0 AND b.yr = a.yr AND b.ln = a.ln AND b.row = a.row + x AND b.col = a.col + y GROUP BY ALL),
u AS (SELECT s.*, s.sat <> 'L5' OR coalesce(k.n, 0) >= 2 AS keep FROM s LEFT JOIN k ON s.sat = 'L5' AND k.yr = s.yr AND k.ln = s.ln AND k.row = s.row AND k.col = s.col)
SELECT {KEYS_SQL}, sat AS sensor, qa // 8 AS pixel_qa, round(CASE WHEN keep THEN nir END, 9) AS nir, round(CASE WHEN keep THEN red END, 9) AS red FROM u WHERE qa % 16 = 0""")
def prepared_landsat(spark, sf_dir: str) -> DataFrame:
    """Three sensors within polygons: scaled, defringed, without the failed corrector's days, with joined quality bands."""
    obs = observations(spark, sf_dir)
    index = ["ok", "ln", "pk", "t", "px"]
    quality = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_shipdate AS t", "l_suppkey AS px", "l_linenumber - 1 AS pixel_qa").where("pixel_qa % 2 = 0").distinct()
    p = Preparation(("1995-01-01", "1998-06-30"), (100, 300), areas(grid(spark, sf_dir)).where("nation % 2 = 0"), 8, defringe=True, kernel=L.striped(2), least=2, corrected=("1990-01-01", "1996-12-31"), quality=quality, index=tuple(index), image=("yr", "ln"))
    raw = _raw(obs)
    parts = {name: raw.where(F.col("sensor") == code) for name, code in (("L5", "A"), ("L7", "R"), ("L8", "N"))}
    return rounded(landsat(parts, p), [*KEYS, "sensor", "pixel_qa"], ["nir", "red"], 9)


_S2 = ["blue", "green", "red", "nir", "swir1", "swir2"]


@query(f"""WITH {HOLDS}, ar AS (SELECT DISTINCT h.px FROM holds h JOIN grid a ON a.px = h.area WHERE a.zone % 2 = 1),
o AS (SELECT * FROM obs QUALIFY count(*) OVER (PARTITION BY yr, ln, doy, t, orbit, sensor, row, col) = 1),
s AS (SELECT o.*, swir1 * 100 AS cloud_probability FROM o WHERE px IN (SELECT px FROM ar) AND t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1998-01-01' AND pk % 3 > 0),
b AS (SELECT yr, ln, doy, orbit, sensor, t, row // 2 AS row, col // 2 AS col, {", ".join(f"avg({b}) AS {b}" for b in _S2)}, arg_min(px, (row, col)) AS px, arg_min(cloud_probability, (row, col)) AS cloud_probability, arg_min(floor(nir * 1e9::DOUBLE), (row, col)) AS ok FROM s GROUP BY ALL),
d AS (SELECT px, orbit, strftime(t, '%Y-%m-%d') AS day, arg_max(nir, (t, ok, ln)) AS nir, arg_max(red, (t, ok, ln)) AS red, arg_max(cloud_probability, (t, ok, ln)) AS cloud_probability, arg_max(sensor, (t, ok, ln)) AS sensor FROM b GROUP BY 1, 2, 3)
SELECT px, orbit, day, round(nir, 9) AS nir, round(red, 9) AS red, round(cloud_probability, 9) AS cloud_probability FROM d""")
def prepared_sentinel2(spark, sf_dir: str) -> DataFrame:
    """Scenes with a joined cloud band, means of blocks of cells, daily mosaics of each orbit."""
    image = ("yr", "ln", "doy", "t", "orbit", "sensor")
    obs = observations(spark, sf_dir)
    once = obs.groupBy(*image, "row", "col").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    scenes = obs.join(once, [*image, "row", "col"], "left_semi").drop("ok", "pk", "qa", "temp")
    cloud = obs.where("pk % 3 > 0").select(*image, "row", "col", (F.col("swir1") * 100).alias("cloud_probability"))
    p = Preparation(("1996-01-01", "1997-12-31"), area=areas(grid(spark, sf_dir)).where("nation % 2 = 1"), tile=8, index=(*image, "row", "col"), image=image, resample="aggregate", factor=2)
    out = sentinel2(scenes.withColumns({"ok": F.floor(F.col("nir") * 1e9), "pk": F.lit(0)}), p, _S2, cloud_probability=cloud)
    return rounded(out.withColumn("day", F.date_format("t", "yyyy-MM-dd")), ["px", "orbit", "day"], {"nir": F.col("nir"), "red": F.col("red"), "cloud_probability": F.col("cloud_probability")}, 9)


@query(f"""WITH r AS (SELECT *, CASE orbit WHEN 'F' THEN 'terra' ELSE 'aqua' END AS platform FROM obs WHERE doy BETWEEN 120 AND 250),
m AS (SELECT *, (swir2 * 10000)::INTEGER AS zenith FROM r WHERE pk % 5 > 0)
SELECT {KEYS_SQL}, platform, round(CASE WHEN zenith < 6000 THEN nir END, 9) AS nir, round(CASE WHEN zenith < 6000 THEN temp END, 9) AS temp FROM m""")
def prepared_modis(spark, sf_dir: str) -> DataFrame:
    """Two platforms' reflectance, temperature and angles by day, masked where the sun is low."""
    obs = observations(spark, sf_dir)
    on = ("px", "t", "ok", "ln", "pk")
    platforms = {}
    for name, code in (("terra", "F"), ("aqua", "O")):
        own = obs.where(F.col("orbit") == code)
        angles = own.where("pk % 5 > 0").select(*on, (F.col("swir2") * 10000).cast("int").alias("SolarZenith")).distinct()
        platforms[name] = {"reflectance": own.drop("temp", "swir2"), "temperature": own.select(*on, "temp").distinct(), "angles": angles}
    p = Preparation(("1990-01-01", "2030-12-31"), (120, 250))
    return rounded(modis(platforms, p, 60, on), [*KEYS, "platform"], ["nir", "temp"], 9)
