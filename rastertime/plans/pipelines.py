"""Whole recipes: scenes of one or two sensors to masked, harmonised scenes and annual composites."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.functions import harmonize as H
from rastertime.functions import indices as I
from rastertime.functions import masks as M
from rastertime.functions.bands import all_band_mask, mask
from rastertime.functions.dates import window_year
from rastertime.operators import change as X
from rastertime.operators import clouds as K
from rastertime.operators import composite as P
from rastertime.plans.history import FIVE, TDOM, _medoid_sql
from rastertime.plans.registry import obs_query, rounded, rounded_sql
from rastertime.plans.scenes import LANDSAT_SCORE, VISIBLE, _score, nd, rescale_sql
from rastertime.sources.catalog import merge

SCENE_BANDS = ["blue", "green", "red", "nir", "swir1", "swir2", "temp"]


@dataclass(frozen=True)
class Options:
    """What a recipe does. The defaults are those of surface-reflectance scenes of the optical family."""

    years: tuple[int, int] = (1995, 2001)
    days: tuple[int, int] = (152, 273)
    buffer: int = 0
    weights: tuple[int, ...] = (1,)
    method: str = "medoid"
    cloud_score: bool = False
    cloud_threshold: float = 10
    cloud_percentile: float = 10
    score_offset: bool = True
    cloud_margin: tuple[float, float] = (0, 0)
    dark_margin: tuple[float, float] = (0, 0)
    image: tuple[str, ...] = ("t",)
    fmask_cloud: bool = True
    fmask_shadow: bool = True
    fmask_snow: bool = False
    version: str = "C2"
    dark_outliers: bool = False
    z: float = -1
    dark_sum: float = 0.35
    dark_bands: tuple[str, ...] = ("nir", "swir1")
    harmonize: bool = False
    cloud_probability: float | None = None
    cloud_score_plus: float | None = None
    stats: DataFrame | None = None


def in_seasons(df: DataFrame, o: Options) -> DataFrame:
    """Observations in the seasons that begin in the years of the options."""
    return df.where(window_year(F.col("t"), *o.days).between(*o.years))


def landsat_scenes(df: DataFrame, o: Options) -> DataFrame:
    """Season, then the masks in their fixed order, then indices; one shuffle by pixel if a history mask is on."""
    df = all_band_mask(in_seasons(df, o), I.SIX)
    if o.cloud_score:
        df = K.cloud_score_mask(df, M.landsat_cloud_score(), SCENE_BANDS, o.cloud_threshold, o.cloud_percentile, o.score_offset, o.stats, contract=o.cloud_margin[0], dilate=o.cloud_margin[1], image=o.image)
    if o.fmask_cloud:
        df = mask(df, M.fmask(F.col("qa"), "cloud", o.version), SCENE_BANDS)
    if o.dark_outliers:
        df = K.shadow_mask(df, SCENE_BANDS, o.z, o.dark_sum, o.dark_bands, o.stats, contract=o.dark_margin[0], dilate=o.dark_margin[1], image=o.image)
    if o.fmask_shadow:
        df = mask(df, M.fmask(F.col("qa"), "shadow", o.version), SCENE_BANDS)
    if o.fmask_snow:
        df = mask(df, M.fmask(F.col("qa"), "snow", o.version), SCENE_BANDS)
    if o.harmonize:
        df = merge(H.roy(df.where("sensor = 'R'")), df.where("sensor <> 'R'"))
    return with_indices(df)


def sentinel2_scenes(df: DataFrame, o: Options) -> DataFrame:
    df = all_band_mask(in_seasons(df, o), I.SIX)
    if o.cloud_score:
        df = K.cloud_score_mask(df, M.sentinel2_cloud_score(), SCENE_BANDS, o.cloud_threshold, o.cloud_percentile, o.score_offset, o.stats, contract=o.cloud_margin[0], dilate=o.cloud_margin[1], image=o.image)
    if o.cloud_probability is not None:
        df = mask(df, F.col("cloud_probability") <= o.cloud_probability, SCENE_BANDS)
    if o.cloud_score_plus is not None:
        df = mask(df, F.col("cloudScorePlus") >= o.cloud_score_plus, SCENE_BANDS)
    if o.dark_outliers:
        df = K.shadow_mask(df, SCENE_BANDS, o.z, o.dark_sum, o.dark_bands, o.stats, contract=o.dark_margin[0], dilate=o.dark_margin[1], image=o.image)
    return with_indices(df)


def modis_scenes(df: DataFrame, o: Options) -> DataFrame:
    df = in_seasons(df, o)
    df = K.cloud_score_mask(df, M.modis_cloud_score(), SCENE_BANDS, o.cloud_threshold, o.cloud_percentile, o.score_offset, o.stats, contract=o.cloud_margin[0], dilate=o.cloud_margin[1], image=o.image)
    return with_indices(K.shadow_mask(df, SCENE_BANDS, o.z, o.dark_sum, ("nir", "swir2"), o.stats, contract=o.dark_margin[0], dilate=o.dark_margin[1], image=o.image))


def with_indices(df: DataFrame) -> DataFrame:
    return df.withColumns(I.simple_indices() | I.tasseled_cap(3)).withColumns(I.tasseled_cap_angles(("BG",)))


def hybrid_scenes(landsat: DataFrame, sentinel2: DataFrame, ol: Options, os: Options) -> DataFrame:
    """Both families on the older sensor's scale; each with its own history statistics."""
    a = landsat_scenes(landsat, replace(ol, harmonize=False))
    b = sentinel2_scenes(sentinel2, os)
    a = merge(H.chastain(a.where("sensor = 'R'"), "OLI", "ETM"), a.where("sensor <> 'R'"))
    b = H.chastain(b, "MSI", "ETM")
    common = [c for c in a.columns if c in b.columns]
    return with_indices(merge(a.select(*common), b.select(*common)))


def composites(scenes: DataFrame, o: Options, bands: list[str] = FIVE) -> DataFrame:
    return P.time_series(scenes.where(F.col(bands[0]).isNotNull()), bands, o.years, o.days, o.buffer, list(o.weights) if len(o.weights) == 2 * o.buffer + 1 else None, o.method)


def climate_composites(df: DataFrame, o: Options, bands: list[str], reducer=F.avg) -> DataFrame:
    return P.time_series(df, bands, o.years, o.days, o.buffer, reducer=reducer)


def interpolated(annual: DataFrame, bands: list[str], years: int, keys: list[str]) -> DataFrame:
    """Annual values filled over up to ``years`` years."""
    return X.linear_interpolation(annual, bands, keys, days=366 * years)


def _shown(out: DataFrame) -> DataFrame:
    return rounded(out, ["px", "year", "compositeObsCount"], FIVE)


def _kept(keep: str, bands: list[str] = SCENE_BANDS) -> str:
    return ", ".join(f"CASE WHEN {keep} THEN {b} END AS {b}" for b in bands)


def _history_sql(score: str, dark: tuple[str, str], cloud: str = "true", shadow: str = "true") -> str:
    """Season, cloud score less its pixel percentile, dark outliers against the pixel's own mean."""
    a, b = dark
    stats = f"avg({a}) OVER w AS nir_m, stddev_pop({a}) OVER w AS nir_s, avg({b}) OVER w AS swir1_m, stddev_pop({b}) OVER w AS swir1_s"
    tdom = TDOM.replace("swir1 -", f"{b} -").replace("nir + swir1", f"{a} + {b}")
    return f"""WITH s0 AS (SELECT *, {score} AS score FROM obs WHERE doy BETWEEN 152 AND 273), s1 AS (SELECT *, quantile_cont(score, 0.1) OVER (PARTITION BY px) AS low FROM s0),
s2 AS (SELECT * REPLACE ({_kept(f"score - low < 20 AND {cloud}")}) FROM s1), s3 AS (SELECT *, {stats} FROM s2 WINDOW w AS (PARTITION BY px)),
s4 AS (SELECT * REPLACE ({_kept(f"NOT coalesce({tdom}, false) AND {shadow}")}) FROM s3)"""


def margin_sql(contract: float, dilate: float, n: str = "") -> str:
    """From p{n} (clear) to k{n} (v = 1 where a cell of an image stays)."""
    same = "b.yr = a.yr AND b.ln = a.ln AND b.row = a.row + d.dr AND b.col = a.col + d.dc"
    return f"""c{n} AS (SELECT yr, ln, row, col, max(clear::INTEGER) AS v FROM p{n} WHERE clear IS NOT NULL GROUP BY ALL), d{n} AS (SELECT x AS dr, y AS dc, x * x + y * y AS r2 FROM range(-3, 4) e(x), range(-3, 4) f(y)),
m{n} AS (SELECT a.yr, a.ln, a.row, a.col, max(b.v) AS v FROM c{n} a, d{n} d JOIN c{n} b ON {same} WHERE r2 <= {contract * contract} GROUP BY ALL),
k{n} AS (SELECT a.yr, a.ln, a.row, a.col, min(b.v) AS v FROM m{n} a, d{n} d JOIN m{n} b ON {same} WHERE r2 <= {dilate * dilate} GROUP BY ALL)"""


MEDIANS = f'count(green) AS "compositeObsCount", {rounded_sql({b: f"median({b})" for b in FIVE})}'


@obs_query(f"""{_history_sql(LANDSAT_SCORE, ("nir", "swir1"), "(qa & 8) = 0", "(qa & 16) = 0")}, {_medoid_sql("SELECT *, yr AS year FROM s4 WHERE green IS NOT NULL", "px, year")}
SELECT px, year, cnt AS "compositeObsCount", {rounded_sql(FIVE)} FROM n WHERE nth = 1""")
def recipe_landsat(obs: DataFrame) -> DataFrame:
    """Cloud score, quality bits, dark outliers, medoid."""
    o = Options(cloud_score=True, cloud_threshold=20, dark_outliers=True)
    return _shown(composites(landsat_scenes(obs, o), o))


DAILY = ", ".join(f"arg_max({b}, (t, ok, ln, pk)) AS {b}" for b in [*FIVE, "yr", "doy"])


@obs_query(f"""WITH d AS (SELECT px, orbit, strftime(t, '%Y-%m-%d') AS day, {DAILY} FROM obs GROUP BY 1, 2, 3)
SELECT px, yr AS year, {MEDIANS} FROM d WHERE doy BETWEEN 152 AND 273 AND swir1 * 2 >= 0.6::DOUBLE GROUP BY px, yr""")
def recipe_sentinel2(obs: DataFrame) -> DataFrame:
    """Daily orbit mosaics and a precomputed cloud band, medians."""
    o = Options(method="median", cloud_score_plus=0.6)
    daily = P.daily_mosaic(obs, [*SCENE_BANDS, "ok", "ln", "pk", "yr", "doy"], ["px", "orbit"]).withColumn("t", F.col("date").cast("timestamp_ntz"))
    return _shown(composites(sentinel2_scenes(daily.withColumn("cloudScorePlus", F.col("swir1") * 2), o), o))


def _inverse_sql(pair: tuple[str, str], when: str = "true") -> str:
    at = {b: i for i, b in enumerate(I.SIX)}
    return ", ".join(f"CASE WHEN {when} THEN ({b} - ({H.CHASTAIN[pair][1][at[b]]})::DOUBLE) / {H.CHASTAIN[pair][0][at[b]]}::DOUBLE ELSE {b} END AS {b}" for b in FIVE)


@obs_query(f"""WITH u AS (SELECT px, yr, doy, {_inverse_sql(("OLI", "ETM"), "sensor = 'R'")} FROM obs WHERE orbit = 'O' AND (qa & 8) = 0 AND (qa & 16) = 0 UNION ALL SELECT px, yr, doy, {_inverse_sql(("MSI", "ETM"))} FROM obs WHERE orbit = 'F'),
w(year, member, weight) AS (SELECT y, y + k - 1, [1, 5, 1][k + 1] FROM range(1996, 2001) a(y), range(0, 3) b(k)), rep AS (SELECT u.*, w.year FROM u JOIN w ON u.yr = w.member, range(0, w.weight) c(i) WHERE doy BETWEEN 152 AND 273)
SELECT px, year::INTEGER AS year, {MEDIANS} FROM rep GROUP BY px, year""")
def recipe_hybrid(obs: DataFrame) -> DataFrame:
    """Two families, harmonised and merged, median over weighted windows of three years."""
    o = Options(method="median", buffer=1, weights=(1, 5, 1))
    return _shown(composites(hybrid_scenes(obs.where("orbit = 'O'"), obs.where("orbit = 'F'").withColumn("cb", F.col("blue")), o, o), o))


MODIS_SCORE = f"CASE WHEN temp IS NULL THEN 100 ELSE {_score(VISIBLE, rescale_sql('nir + swir2 + swir2', 0.3, 0.8), rescale_sql(nd('green', 'swir2'), 0.8, 0.6))} END"


@obs_query(f"""{_history_sql(MODIS_SCORE, ("nir", "swir2"))} SELECT px, yr AS year, {MEDIANS} FROM s4 WHERE green IS NOT NULL GROUP BY px, yr""")
def recipe_modis(obs: DataFrame) -> DataFrame:
    o = Options(method="median", cloud_threshold=20)
    return _shown(composites(modis_scenes(obs, o), o))


@obs_query("""WITH y AS (SELECT y, make_date(y::INTEGER, 1, 1) AS jan FROM range(1995, 2002) r(y))
SELECT px, (y + 1)::INTEGER AS year, count(nir) AS "compositeObsCount", round(avg(nir), 9) AS nir, round(avg(temp), 9) AS temp
FROM y JOIN obs ON t::DATE >= jan + 273 AND t::DATE <= jan + (273 - 1 + 365) GROUP BY px, y""")
def recipe_climate(obs: DataFrame) -> DataFrame:
    """Means over water years, October to September, dated to the later year."""
    out = climate_composites(obs, Options(days=(274, 273)), ["nir", "temp"])
    return rounded(out, ["px", "year", "compositeObsCount"], ["nir", "temp"], 9)


@obs_query(f"""WITH s0 AS (SELECT *, {LANDSAT_SCORE} AS score FROM obs WHERE doy BETWEEN 152 AND 273), p AS (SELECT *, score - quantile_cont(score, 0.1) OVER (PARTITION BY px) < 20 AS clear FROM s0),
{margin_sql(1.5, 2.5)}, s1 AS (SELECT p.* REPLACE ({_kept("v = 1 AND clear IS NOT NULL")}) FROM p LEFT JOIN k USING (yr, ln, row, col)), s2 AS (SELECT * REPLACE ({_kept("(qa & 8) = 0")}) FROM s1),
s3 AS (SELECT * EXCLUDE (clear), avg(nir) OVER w AS nir_m, stddev_pop(nir) OVER w AS nir_s, avg(swir1) OVER w AS swir1_m, stddev_pop(swir1) OVER w AS swir1_s FROM s2 WINDOW w AS (PARTITION BY px)),
p2 AS (SELECT *, NOT coalesce({TDOM}, false) AS clear FROM s3), {margin_sql(1, 1.5, "2")}, s4 AS (SELECT p2.* REPLACE ({_kept("v = 1 AND clear IS NOT NULL AND (qa & 16) = 0")}) FROM p2 LEFT JOIN k2 USING (yr, ln, row, col))
SELECT px, yr AS year, {MEDIANS} FROM s4 WHERE green IS NOT NULL GROUP BY px, yr""")
def recipe_margins(obs: DataFrame) -> DataFrame:
    """Cloud score and dark outliers, each with its margin in every image, quality bits, medians."""
    o = Options(method="median", cloud_score=True, cloud_threshold=20, dark_outliers=True, cloud_margin=(1.5, 2.5), dark_margin=(1, 1.5), image=("yr", "ln"))
    return _shown(composites(landsat_scenes(obs, o), o))
