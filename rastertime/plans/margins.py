"""Queries of masks with margins, annual outputs of several bands, slight changes, colour and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.functions import indices as I
from rastertime.functions import masks as M
from rastertime.functions import segments as S
from rastertime.functions.indices import SIX
from rastertime.operators import change as X
from rastertime.operators import clouds as K
from rastertime.operators import focal as L
from rastertime.plans.history import ANNUAL, SEGS, TDOM, ZT, annual, verts
from rastertime.plans.pipelines import margin_sql
from rastertime.plans.registry import KEYS, KEYS_SQL, obs_query, rounded
from rastertime.plans.scenes import INFRARED, LANDSAT_SCORE, TC_VIEW, VISIBLE, _score, nd, rescale_sql
from rastertime.plans.space import grid_query
from rastertime.sources.catalog import path_row, without_gaps
from rastertime.sources.sinks import pack

#: What makes an image of the observations: a year and a line number.
IMAGE = ("yr", "ln")


def _shown(band: str) -> str:
    return f"SELECT {KEYS_SQL}, CASE WHEN v = 1 AND clear IS NOT NULL THEN {band} END AS {band} FROM p LEFT JOIN k USING (yr, ln, row, col)"


@obs_query(f"""WITH s AS (SELECT *, {LANDSAT_SCORE} AS score FROM obs), p AS (SELECT *, score - quantile_cont(score, 0.1) OVER (PARTITION BY px) < 20 AS clear FROM s),
{margin_sql(1.5, 2.5)} {_shown("nir")}""")
def cloud_score_margin(obs: DataFrame) -> DataFrame:
    return K.cloud_score_mask(obs, M.landsat_cloud_score(), ["nir"], contract=1.5, dilate=2.5, image=IMAGE).select(*KEYS, "nir")


@obs_query(f"""WITH o AS (SELECT *, avg(nir) OVER w AS nir_m, stddev_pop(nir) OVER w AS nir_s, avg(swir1) OVER w AS swir1_m, stddev_pop(swir1) OVER w AS swir1_s FROM obs WINDOW w AS (PARTITION BY px)),
p AS (SELECT *, NOT coalesce({TDOM}, false) AS clear FROM o), {margin_sql(1, 1.5)} {_shown("red")}""")
def tdom_margin(obs: DataFrame) -> DataFrame:
    return K.shadow_mask(obs, ["red"], contract=1, dilate=1.5, image=IMAGE).select(*KEYS, "red")


@obs_query(f"""WITH p AS (SELECT *, NOT (({nd("green", "swir1")} > 0.4::DOUBLE AND nir > 0.11::DOUBLE) OR ({nd("green", "swir1")} > 0.1::DOUBLE AND {nd("green", "swir1")} < 0.4::DOUBLE)) AS clear FROM obs),
{margin_sql(0, 1.5)} {_shown("nir")}""")
def snow_margin(obs: DataFrame) -> DataFrame:
    out = K.with_margin(obs, ~M.snow(), 0, 1.5, IMAGE)
    return B.mask(out, F.col("keep"), ["nir"]).select(*KEYS, "nir")


@obs_query(f"""WITH {TC_VIEW}, w AS (SELECT *, round(atan2(wetness, brightness) / pi(), 9) AS bw, round(atan2(greenness, brightness) / pi(), 9) AS bg FROM tc),
p AS (SELECT *, bw >= -0.05::DOUBLE AND bg <= 0.05::DOUBLE AND brightness < 0.3::DOUBLE AND px % 4 > 0 AS clear FROM w), {margin_sql(0, 1)}
SELECT {KEYS_SQL}, coalesce(v = 1, false) AS water FROM p LEFT JOIN k USING (yr, ln, row, col)""")
def water_margin(obs: DataFrame) -> DataFrame:
    """Water on flat ground, less its outermost cells."""
    rows = obs.withColumns(I.tasseled_cap(3)).withColumns({n: F.round(c, 9) for n, c in I.tasseled_cap_angles(("BG", "BW")).items()})
    return K.with_margin(rows, M.water(F.col("px") % 4 > 0), 0, 1, IMAGE).select(*KEYS, F.col("keep").alias("water"))


def _annual_sql(name: str, last: int, by: int) -> str:
    fit = "end_fit - (end_fit - start_fit) / dur * (yr - y)"
    return f"""{name} AS (SELECT px, y, dur, ({fit}) * {by} AS fit, (end_fit - start_fit) * {by} AS mag, (end_fit - start_fit) / dur * {by} AS slope, ({fit} - start_fit) * {by} AS diff
FROM sg, range(1995, 2002) r(y) WHERE yr <= {last} AND (y > start OR (y = 1995 AND start = 1995)) AND y <= yr)"""


FIELDS = ["fit", "mag", "slope", "diff"]


@obs_query(f"""WITH {SEGS}, {_annual_sql("a", 2001, 1)}, {_annual_sql("b", 1999, 100)}
SELECT a.px, a.y::INTEGER AS year, a.dur::INTEGER AS "NBR_LT_dur", b.dur::INTEGER AS "NDVI_LT_dur", {", ".join(f'round({t}.{f}, 6) AS "{n}_LT_{f}"' for t, n in (("a", "NBR"), ("b", "NDVI")) for f in FIELDS)} FROM a LEFT JOIN b ON a.px = b.px AND a.y = b.y""")
def fit_stack_bands(obs: DataFrame) -> DataFrame:
    """Two bands' models, of which the second ends in 1999, to annual values side by side."""
    rows = verts(obs).withColumn("short", S.scaled(F.filter("verts", lambda v: v["yr"] <= 1999), 100))
    out = S.annual_many(rows, {"NBR": "verts", "NDVI": "short"}, 1995, 2001, ["px"])
    return rounded(out, ["px", "year", "NBR_LT_dur", "NDVI_LT_dur"], [f"{n}_LT_{f}" for n in ("NBR", "NDVI") for f in FIELDS])


@obs_query(f"""WITH {SEGS}, {_annual_sql("a", 2001, 1)}
SELECT px, y::INTEGER AS year, dur::SMALLINT AS "NBR_LT_dur", {", ".join(f'trunc(round({f}, 9) * 10000)::SMALLINT AS "NBR_LT_{f}"' for f in FIELDS)} FROM a""")
def fit_stack_packed(obs: DataFrame) -> DataFrame:
    """Annual values as 16-bit integers for export."""
    out = S.annual_many(verts(obs), {"NBR": "verts"}, 1995, 2001, ["px"])
    names = [f"NBR_LT_{f}" for f in FIELDS]
    return pack(rounded(out, ["px", "year", "NBR_LT_dur"], names, 9), ["NBR_LT_dur", *names], keep=("NBR_LT_dur",))


SLIGHT = "CASE WHEN {0} * -1 > {1} AND {0} * -1 < {2} THEN year END"


@obs_query(ZT + f""", e AS (SELECT px, year, day0, CASE WHEN n >= 10 THEN (x - mu) / NULLIF(sd, 0) * 10 END AS z, slope * 10000 AS slope FROM g)
SELECT px, year, day0, {SLIGHT.format("z", 5, 12)} AS "nir_Z_change", {SLIGHT.format("slope", 100, 400)} AS nir_slope_change FROM e""")
def z_threshold_subtle(obs: DataFrame) -> DataFrame:
    out = X.z_and_trend(obs, ["nir"], (1995, 2001), (100, 300), 50, 3, 1, 5, 10)
    return X.threshold_z_and_trend_subtle(out, ["nir"], (-0.5, -1.2), (-0.01, -0.04)).select("px", "year", "day0", "nir_Z_change", "nir_slope_change")


@obs_query(f"WITH {ANNUAL} SELECT px, yr, CASE WHEN v > 0.28 THEN round(v * 2, 9) END AS v FROM ann")
def masked_again(obs: DataFrame) -> DataFrame:
    """Values filled for a model, masked where the years before the filling were."""
    rows = annual(obs)
    out = X.masked_by(rows.withColumn("v", F.col("v") * 2), ["v"], rows.where(F.col("v") > 0.28), ["px", "yr"])
    return rounded(out, ["px", "yr"], ["v"], 9)


@obs_query(f"""WITH h AS (SELECT *, greatest(red, nir, swir1) AS hi, least(red, nir, swir1) AS lo FROM obs),
t AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = red THEN (nir - swir1) / (hi - lo) + CASE WHEN nir < swir1 THEN 6 ELSE 0 END WHEN hi = nir THEN (swir1 - red) / (hi - lo) + 2 ELSE (red - nir) / (hi - lo) + 4 END AS turn FROM h)
SELECT {KEYS_SQL}, round(turn / 6, 9) AS h, round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END, 9) AS s, round(hi, 9) AS v, round(red, 9) AS r, round(nir, 9) AS g, round(swir1, 9) AS b FROM t""")
def hue_saturation_value(obs: DataFrame) -> DataFrame:
    """Three bands as colours to hue, saturation and value, and back."""
    rows = obs.withColumn("_h", B.rgb_to_hsv(F.col("red"), F.col("nir"), F.col("swir1")))
    rows = rows.withColumn("_c", B.hsv_to_rgb(F.col("_h.h"), F.col("_h.s"), F.col("_h.v")))
    return rounded(rows, KEYS, {n: F.col(f"_{k}.{n}") for k, names in (("h", "hsv"), ("c", "rgb")) for n in names}, 9)


@obs_query(f"SELECT {KEYS_SQL}, round(2.5::DOUBLE * (nir - red) / (nir + 6 * red - 7.5::DOUBLE * blue + 1), 9) AS evi FROM obs")
def band_expression(obs: DataFrame) -> DataFrame:
    evi = B.expression("2.5D * (N - R) / (N + 6 * R - 7.5D * B + 1)", {"N": "nir", "R": "red", "B": "blue"})
    return rounded(obs, KEYS, {"evi": evi}, 9)


@obs_query(f"""SELECT {KEYS_SQL}, (px::VARCHAR || ln::VARCHAR)::BIGINT AS "pathRow", round(CASE WHEN nir > 0 THEN 10 * log10(nir) END, 9) AS db, round(nir, 9) AS back
FROM obs WHERE NOT (sensor = 'R' AND t >= TIMESTAMP '1998-06-01')""")
def scene_properties(obs: DataFrame) -> DataFrame:
    """Without one sensor's scenes after its failure; path and row as one number; a band in decibels and back."""
    rows = path_row(without_gaps(obs, "1998-05-31", seven="R"), "px", "ln").withColumn("db", B.to_db(F.col("nir")))
    return rounded(rows, [*KEYS, "pathRow"], {"db": F.col("db"), "back": B.to_natural(F.col("db"))}, 9)


@grid_query("""WITH p AS (SELECT row + 0.25::DOUBLE AS y, col + 0.5::DOUBLE AS x FROM grid), n AS (SELECT y, x, floor(y) + i AS row, floor(x) + j AS col FROM p, range(-1, 3) a(i), range(-1, 3) b(j)),
d AS (SELECT n.y, n.x, abs(n.y - n.row) AS u, abs(n.x - n.col) AS v, grid.z FROM n LEFT JOIN grid ON grid.row = n.row AND grid.col = n.col),
m AS (SELECT y, x, z, CASE WHEN u <= 1 THEN 1.5::DOUBLE * u ** 3 - 2.5::DOUBLE * u ** 2 + 1 ELSE -0.5::DOUBLE * u ** 3 + 2.5::DOUBLE * u ** 2 - 4 * u + 2 END
 * CASE WHEN v <= 1 THEN 1.5::DOUBLE * v ** 3 - 2.5::DOUBLE * v ** 2 + 1 ELSE -0.5::DOUBLE * v ** 3 + 2.5::DOUBLE * v ** 2 - 4 * v + 2 END AS w FROM d)
SELECT y, x, CASE WHEN count(z) = 16 THEN round(sum(z * w), 6) END AS z FROM m GROUP BY y, x""")
def resample_bicubic(g: DataFrame) -> DataFrame:
    points = g.select((F.col("row") + B.dbl(0.25)).alias("y"), (F.col("col") + B.dbl(0.5)).alias("x"))
    return rounded(L.bicubic(g, points, "z"), ["y", "x"], ["z"])


def _opened(source: str, name: str, out: str, contract: float, dilate: float) -> str:
    """``out`` (yr, row, col, name): least within ``contract``, then largest within ``dilate``, of a view of whole images."""
    near = lambda a, b: f"b.yr = a.yr AND b.row = a.row + x AND b.col = a.col + y"  # noqa: E731, F541
    step = lambda src, f, r: f"SELECT a.yr, a.row, a.col, {f}(b.{name}) AS {name} FROM {src} a, range(-3, 4) p(x), range(-3, 4) q(y) JOIN {src} b ON {near('a', 'b')} WHERE x * x + y * y <= {r * r} GROUP BY ALL"
    return f"{out}_0 AS ({step(source, 'min', contract)}), {out} AS ({step(f'{out}_0', 'max', dilate)})"


S2_SCORE = _score(f'greatest(0::DOUBLE, {rescale_sql("blue", 0.1, 0.5)}, {rescale_sql("blue * 2", 0.1, 0.5)})', VISIBLE, INFRARED, rescale_sql(nd("green", "swir1"), 0.8, 0.6))


@obs_query(f"""WITH im AS (SELECT yr, row, col, {", ".join(f"avg({b}) AS {b}" for b in SIX)} FROM obs WHERE yr BETWEEN 1995 AND 1997 GROUP BY ALL),
fl AS (SELECT yr, row, col, coalesce({S2_SCORE} > 12, false)::INTEGER AS cloud, (nir + swir1 + swir2 < 1.4::DOUBLE)::INTEGER AS dark FROM im), {_opened("fl", "cloud", "cl", 0.5, 1)}, {_opened("fl", "dark", "dk", 0.5, 1)},
th AS (SELECT DISTINCT yr, row + round(h * tan(radians(40)) * cos(radians(135 + 20 * (yr - 1995)) + pi()) / 30)::BIGINT AS row, col + round(h * tan(radians(40)) * sin(radians(135 + 20 * (yr - 1995)) + pi()) / 30)::BIGINT AS col FROM cl, (VALUES (60), (90), (150)) v(h) WHERE cloud = 1),
sh AS (SELECT cl.yr, cl.row, cl.col, CASE WHEN th.yr IS NOT NULL AND cloud = 0 THEN dark ELSE 0 END AS s FROM cl JOIN dk USING (yr, row, col) LEFT JOIN th USING (yr, row, col)), {_opened("sh", "s", "so", 0.5, 1)}
SELECT im.yr, im.row, im.col, so.s AS "cloudShadowMask", round(CASE WHEN so.s = 0 AND cl.cloud = 0 THEN nir END, 9) AS nir FROM im JOIN so USING (yr, row, col) JOIN cl USING (yr, row, col)""")
def shadow_wrapper(obs: DataFrame) -> DataFrame:
    """Yearly images without clouds by score and without the dark ground that these throw shadows on; each image has its sun."""
    image = obs.where(F.col("yr").between(1995, 1997)).groupBy("yr", "row", "col").agg(*[F.avg(b).alias(b) for b in SIX]).withColumn("cb", F.col("blue") * 2)
    dark = F.col("nir") + F.col("swir1") + F.col("swir2") < B.dbl(1.4)
    sun = (F.lit(135) + (F.col("yr") - 1995) * 20).cast("double")
    out = K.shadows_projected(image, ["nir"], ["yr"], M.sentinel2_cloud_score() > 12, dark, sun, B.dbl(40), [60, 90, 150], 30, 0.5, 1)
    return rounded(out, ["yr", "row", "col", "cloudShadowMask"], ["nir"], 9)
