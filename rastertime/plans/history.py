"""Queries on pixel histories: composites, history-based masks, joins, change, regression, segments."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.functions import ccdc as C
from rastertime.functions import indices as I
from rastertime.functions import masks as M
from rastertime.functions import segments as S
from rastertime.functions.dates import season_year, window_year
from rastertime.operators import change as X
from rastertime.operators import clouds as K
from rastertime.operators import composite as P
from rastertime.operators import joins as J
from rastertime.operators import patches
from rastertime.operators import regress as R
from rastertime.plans.registry import KEYS, KEYS_SQL, obs_query, query, rounded, rounded_sql
from rastertime.plans.scenes import LANDSAT_SCORE, nd
from rastertime.sources.observations import KEY, observations, table

FIVE = ["green", "red", "nir", "swir1", "swir2"]
SEASON = (152, 273)
CLEAR = "(qa & 8) = 0 AND (qa & 16) = 0"
TIE = "t, ok, ln, pk"


def clear(obs: DataFrame) -> DataFrame:
    """Observations without cloud or shadow bits."""
    return obs.where(M.fmask(F.col("qa"), "cloud") & M.fmask(F.col("qa"), "shadow"))


def _medoid_sql(source: str, keys: str, bands: list[str] = FIVE) -> str:
    med = ", ".join(f"median({b}) AS m_{b}" for b in FIVE)
    far = " + ".join(f"pow({b} - m_{b}, 2)" for b in FIVE)
    on = " AND ".join(f"r.{k} = m.{k}" for k in keys.split(", "))
    return f"""r AS ({source}), m AS (SELECT {keys}, {med} FROM r GROUP BY ALL), f AS (SELECT r.*, {far} AS far FROM r JOIN m ON {on}),
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY far, {TIE}) AS nth, count(*) OVER (PARTITION BY {keys}) AS cnt FROM f)"""


@obs_query(f"""WITH {_medoid_sql(f"SELECT *, yr AS year FROM obs WHERE {CLEAR} AND doy BETWEEN 152 AND 273", "px, year")}
SELECT px, year, cnt AS "compositeObsCount", year(t)::INTEGER AS obs_year, dayofyear(t)::INTEGER AS "julianDay", {rounded_sql({b: b for b in FIVE} | {'NDVI': nd('nir', 'red')})} FROM n WHERE nth = 1""")
def composite_medoid(obs: DataFrame) -> DataFrame:
    out = P.time_series(clear(obs), FIVE, (1995, 2001), SEASON)
    return rounded(out, ["px", "year", "compositeObsCount", "obs_year", "julianDay"], {b: F.col(b) for b in FIVE} | {"NDVI": I.simple_indices()["NDVI"]})


@obs_query(f"SELECT px, yr AS year, count(green) AS \"compositeObsCount\", {rounded_sql({b: f'median({b})' for b in FIVE})} FROM obs WHERE {CLEAR} AND doy BETWEEN 152 AND 273 GROUP BY px, yr")
def composite_median(obs: DataFrame) -> DataFrame:
    return rounded(P.time_series(clear(obs), FIVE, (1995, 2001), SEASON, method="median"), ["px", "year", "compositeObsCount"], FIVE)


# windows by dates: day 274 of a year to 120 - 1 + 365 days after its 1 January; the later year holds more of the days
WRAPPED = """y AS (SELECT y, make_date(y::INTEGER, 1, 1) AS jan FROM range(1995, 2002) r(y)),
wr AS (SELECT obs.*, (y + 1)::INTEGER AS year FROM y JOIN obs ON t::DATE >= jan + 273 AND t::DATE <= jan + (120 - 1 + 365))"""


@obs_query(f"WITH {WRAPPED} SELECT px, year, count(green) AS \"compositeObsCount\", {rounded_sql({b: f'avg({b})' for b in FIVE}, 8)} FROM wr GROUP BY px, year")
def composite_mean_reducer(obs: DataFrame) -> DataFrame:
    return rounded(P.time_series(obs, FIVE, (1995, 2001), (274, 120), reducer=F.avg), ["px", "year", "compositeObsCount"], FIVE, 8)


@obs_query(f"""WITH {WRAPPED}, {_medoid_sql(f"SELECT * FROM wr WHERE {CLEAR}", "px, year")}
SELECT px, year, cnt AS "compositeObsCount", year(t)::INTEGER AS obs_year, dayofyear(t)::INTEGER AS "julianDay", {rounded_sql(FIVE)} FROM n WHERE nth = 1""")
def composite_wrapped_medoid(obs: DataFrame) -> DataFrame:
    """Medoids of seasons that wrap over New Year."""
    return rounded(P.time_series(clear(obs), FIVE, (1995, 2001), (274, 120)), ["px", "year", "compositeObsCount", "obs_year", "julianDay"], FIVE)


@obs_query(f"""WITH {WRAPPED}, w AS (SELECT px, year + k AS year, green, nir FROM wr, range(-1, 2) a(k), range(0, CASE WHEN k = 0 THEN 3 ELSE 1 END) b(i) WHERE year + k BETWEEN 1997 AND 2001)
SELECT px, year::INTEGER AS year, count(green) AS "compositeObsCount", {rounded_sql({b: f'median({b})' for b in ('green', 'nir')})} FROM w GROUP BY px, year""")
def composite_wrapped_weighted(obs: DataFrame) -> DataFrame:
    """Medians over weighted windows of three seasons that wrap over New Year."""
    return rounded(P.time_series(obs, ["green", "nir"], (1995, 2001), (274, 120), 1, [1, 3, 1], "median"), ["px", "year", "compositeObsCount"], ["green", "nir"])


@obs_query(f"""WITH w(year, member, weight) AS (SELECT y, y + k - 1, [1, 5, 1][k + 1] FROM range(1996, 2001) a(y), range(0, 3) b(k)),
rep AS (SELECT obs.*, w.year FROM obs JOIN w ON obs.yr = w.member, range(0, w.weight) c(i) WHERE doy BETWEEN 152 AND 273 AND {CLEAR})
SELECT px, year::INTEGER AS year, count(green) AS "compositeObsCount", {rounded_sql({b: f'median({b})' for b in FIVE})} FROM rep GROUP BY px, year""")
def composite_weighted3(obs: DataFrame) -> DataFrame:
    return rounded(P.time_series(clear(obs), FIVE, (1995, 2001), SEASON, 1, [1, 5, 1], "median"), ["px", "year", "compositeObsCount"], FIVE)


@obs_query(f"""SELECT px, yr, ((doy - 60) // 32 * 32 + 60)::INTEGER AS start, count(nir) AS "compositeObsCount", {rounded_sql({'nir': 'median(nir)', 'red': 'median(red)'})}
FROM obs WHERE doy >= 60 AND (doy - 60) // 32 * 32 + 60 <= 300 GROUP BY px, yr, 3""")
def composite_nday(obs: DataFrame) -> DataFrame:
    return rounded(P.n_day(obs, ["nir", "red"], (60, 300), 32), ["px", "yr", "start", "compositeObsCount"], ["nir", "red"])


@obs_query(f"""WITH m AS (SELECT px, yr, median(nir) AS c_nir, median(red) AS c_red FROM obs GROUP BY px, yr)
SELECT o.px, o.yr, arg_min(doy, (round(abs(nir - c_nir), 12), t, ok, ln, pk)) AS nir_doy, arg_min(doy, (round(abs(red - c_red), 12), t, ok, ln, pk)) AS red_doy FROM obs o JOIN m ON o.px = m.px AND o.yr = m.yr GROUP BY o.px, o.yr""")
def composite_dates(obs: DataFrame) -> DataFrame:
    composite = P.annual_median(obs, ["nir", "red"], (1995, 2001))
    return P.composite_dates(obs, composite, ["nir", "red"], ["px", "yr"])


@obs_query(f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY px, yr ORDER BY {nd('nir', 'red')} DESC NULLS LAST, {TIE}) AS nth FROM obs) SELECT px, yr, red, nir, swir1 FROM n WHERE nth = 1")
def quality_mosaic(obs: DataFrame) -> DataFrame:
    return P.quality_mosaic(obs, ["red", "nir", "swir1"], ["px", "yr"], I.simple_indices()["NDVI"])


@obs_query(f"""WITH p AS (SELECT *, quantile_cont(nir, 0.25) OVER (PARTITION BY px, yr) AS q FROM obs), n AS (SELECT *, row_number() OVER (PARTITION BY px, yr ORDER BY round(abs(nir - q), 12), {TIE}) AS nth FROM p)
SELECT px, yr, red, nir, swir1 FROM n WHERE nth = 1""")
def custom_quality_mosaic(obs: DataFrame) -> DataFrame:
    return P.percentile_mosaic(obs, ["red", "nir", "swir1"], ["px", "yr"], "nir", 25)


@obs_query("SELECT px, yr, count(*) AS n, count(CASE WHEN (qa & 8) = 0 THEN nir END) AS clear FROM obs GROUP BY px, yr")
def obs_count(obs: DataFrame) -> DataFrame:
    return obs.groupBy("px", "yr").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(M.fmask(F.col("qa"), "cloud"), F.col("nir"))).alias("clear"))


@obs_query(f"""WITH y AS (SELECT y::INTEGER AS season, make_date(y::INTEGER, 1, 1) AS jan FROM range(1990, 2003) r(y))
SELECT px, season, {rounded_sql({'nir': 'median(nir)'})}, count(nir) AS "compositeObsCount" FROM y JOIN obs ON t::DATE >= jan + 299 AND t::DATE <= jan + (60 - 1 + 365) GROUP BY 1, 2""")
def wrap_dates_composite(obs: DataFrame) -> DataFrame:
    rows = obs.where(window_year(F.col("t"), 300, 60).isNotNull()).withColumn("season", season_year(F.col("t"), 300, 60).cast("int"))
    return rounded(P.reduce_bands(rows, ["nir"], ["px", "season"]), ["px", "season", "compositeObsCount"], ["nir"])


@obs_query(f"SELECT px, orbit, strftime(t, '%Y-%m-%d') AS day, arg_max(nir, (t, ok, ln, pk)) AS nir, arg_max(red, (t, ok, ln, pk)) FILTER (WHERE ln <> 2) AS red FROM obs GROUP BY 1, 2, 3")
def daily_mosaic(obs: DataFrame) -> DataFrame:
    holes = obs.withColumn("red", F.when(F.col("ln") != 2, F.col("red")))
    return P.daily_mosaic(holes, ["nir", "red"], ["px", "orbit"]).select("px", "orbit", F.date_format("date", "yyyy-MM-dd").alias("day"), "nir", "red")


@obs_query("SELECT px, " + ", ".join(f"round(median(CASE WHEN yr = {y} THEN nir END), 6) AS y{y}" for y in range(1995, 2002)) + " FROM obs GROUP BY px")
def collection_to_bands(obs: DataFrame) -> DataFrame:
    wide = P.to_bands(P.annual_median(obs, ["nir"], (1995, 2001)), "yr", list(range(1995, 2002)), "nir")
    return wide.select("px", *[F.round(F.col(str(y)), 6).alias(f"y{y}") for y in range(1995, 2002)])


@obs_query(f"""WITH s AS (SELECT *, {LANDSAT_SCORE} AS score FROM obs), p AS (SELECT *, quantile_cont(score, 0.1) OVER (PARTITION BY px) AS low FROM s)
SELECT {KEYS_SQL}, CASE WHEN score - low < 20 THEN nir END AS nir FROM p""")
def cloud_score_offset(obs: DataFrame) -> DataFrame:
    return K.cloud_score_mask(obs, M.landsat_cloud_score(), ["nir"]).select(*KEYS, "nir")


TDOM = "round((nir - nir_m) / NULLIF(nir_s, 0), 9) < -1 AND round((swir1 - swir1_m) / NULLIF(swir1_s, 0), 9) < -1 AND nir + swir1 < 0.35::DOUBLE"


@obs_query(f"""WITH m AS (SELECT *, avg(nir) OVER w AS nir_m, stddev_pop(nir) OVER w AS nir_s, avg(swir1) OVER w AS swir1_m, stddev_pop(swir1) OVER w AS swir1_s FROM obs WINDOW w AS (PARTITION BY px))
SELECT {KEYS_SQL}, CASE WHEN NOT coalesce({TDOM}, false) THEN red END AS red FROM m""")
def tdom_mask(obs: DataFrame) -> DataFrame:
    return K.shadow_mask(obs, ["red"]).select(*KEYS, "red")


@obs_query(f"""WITH m AS (SELECT px, avg(nir) AS nir_m, stddev_pop(nir) AS nir_s, avg(swir1) AS swir1_m, stddev_pop(swir1) AS swir1_s FROM obs GROUP BY px)
SELECT {KEYS_SQL}, CASE WHEN NOT coalesce({TDOM}, false) THEN red END AS red FROM obs LEFT JOIN m USING (px)""")
def join_px_stats(obs: DataFrame) -> DataFrame:
    return K.shadow_mask(obs, ["red"], stats=K.pixel_statistics(obs, M.landsat_cloud_score())).select(*KEYS, "red")


# ---- joins


@obs_query("SELECT a.px, a.yr, a.nir AS nir, b.nir AS nir_r FROM (SELECT px, yr, round(median(nir), 6) AS nir FROM obs WHERE sensor = 'A' GROUP BY ALL) a JOIN (SELECT px, yr, round(median(nir), 6) AS nir FROM obs WHERE sensor = 'R' GROUP BY ALL) b USING (px, yr)")
def join_equi(obs: DataFrame) -> DataFrame:
    a, b = (P.annual_median(obs.where(F.col("sensor") == s), ["nir"], (1995, 2001)).withColumn("nir", F.round("nir", 6)) for s in "AR")
    return J.equi(a, b, ["px", "yr"], "_r")


@obs_query("""SELECT a.px, a.yr, a.g AS g, b.g AS g_r FROM (SELECT px, yr, min(green) AS g FROM obs WHERE sensor = 'A' GROUP BY ALL) a JOIN (SELECT px, yr, min(green) AS g FROM obs WHERE sensor = 'R' GROUP BY ALL) b USING (px, yr)
WHERE least(a.g, b.g) <> 0""")
def join_mask_zero(obs: DataFrame) -> DataFrame:
    a, b = (obs.where(F.col("sensor") == s).groupBy("px", "yr").agg(F.min("green").alias("g")) for s in "AR")
    return J.equi(a, b, ["px", "yr"], "_r", mask_zero=True)


NEAR_SQL = "(abs(epoch(a.t) - epoch(b.t)))::BIGINT"


@obs_query(f"""SELECT a.px, a.ok, a.ln, a.pk, a.doy, min({NEAR_SQL}) AS gap_seconds, arg_min(b.nir, ({NEAR_SQL}, b.ok, b.ln, b.pk)) AS nir_2 FROM obs a JOIN obs b ON a.px = b.px AND a.sensor = 'A' AND b.sensor = 'R' AND {NEAR_SQL} <= 16 * 86400
GROUP BY a.px, a.ok, a.ln, a.pk, a.t, a.doy""")
def join_nearest_time(obs: DataFrame) -> DataFrame:
    cols = [*KEY, "doy", "nir"]
    a, b = (obs.where(F.col("sensor") == s).select(*cols) for s in "AR")
    return J.nearest_in_time(a, b, ["px"], 16 * 24, KEY, ["ok", "ln", "pk"]).select("px", "ok", "ln", "pk", "doy", "gap_seconds", "nir_2")


BOX = "col - 0.5::DOUBLE AS x0, col + 0.6::DOUBLE AS x1, row - 0.5::DOUBLE AS y0, row + 0.6::DOUBLE AS y1"


@obs_query(f"""WITH a AS (SELECT *, {BOX} FROM obs WHERE sensor = 'A'), b AS (SELECT *, {BOX} FROM obs WHERE sensor = 'R')
SELECT a.px, a.ok, a.ln, a.pk, a.doy, arg_min(b.px, ({NEAR_SQL}, b.px, b.ok, b.ln, b.pk)) AS px_2, min({NEAR_SQL}) AS gap_seconds FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND {NEAR_SQL} <= 24 * 3600
GROUP BY a.px, a.ok, a.ln, a.pk, a.t, a.doy""")
def join_spatiotemporal(obs: DataFrame) -> DataFrame:
    box = {"x0": F.col("col") - B.dbl(0.5), "x1": F.col("col") + B.dbl(0.6), "y0": F.col("row") - B.dbl(0.5), "y1": F.col("row") + B.dbl(0.6)}
    rows = obs.withColumns(box).select(*KEY, "doy", "sensor", *box)
    a, b = rows.where("sensor = 'A'").drop("sensor"), rows.where("sensor = 'R'").drop("sensor")
    return J.spatio_temporal(a, b, 24, KEY, ["px", "ok", "ln", "pk"], 2.0).select("px", "ok", "ln", "pk", "doy", "px_2", "gap_seconds")


@query("SELECT s_suppkey, s_nationkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", obs=False)
def join_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.features(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "s_nationkey", "n_nationkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)", obs=False)
def missing_ids_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    seen = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("id"))
    return orders.join(J.missing_ids(orders, seen, ["id"]), "id").select("o_custkey").distinct()


# ---- change

ANNUAL = f"ann AS (SELECT px, yr, median(nir) AS nir, median(red) AS red, median({nd('nir', 'red')}) AS v FROM obs WHERE {CLEAR} AND doy BETWEEN 152 AND 273 GROUP BY px, yr)"


def annual(obs: DataFrame) -> DataFrame:
    rows = clear(obs).where(F.col("doy").between(*SEASON)).withColumn("v", I.simple_indices()["NDVI"])
    return P.annual_median(rows, ["nir", "red", "v"], (1995, 2001))


@obs_query(f"WITH {ANNUAL} SELECT px, yr, {rounded_sql(['nir', 'red', 'v'])} FROM ann")
def annual_median(obs: DataFrame) -> DataFrame:
    return rounded(annual(obs), ["px", "yr"], ["nir", "red", "v"])


@obs_query(f"WITH {ANNUAL}, n AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, lag(nir) OVER w AS nb, lead(nir) OVER w AS na FROM ann WINDOW w AS (PARTITION BY px ORDER BY yr)), "
           "s AS (SELECT *, coalesce((v - b > 0.03 AND v - a > 0.03) OR (b - v > 0.03 AND a - v > 0.03), false) AS spike FROM n) "
           "SELECT px, yr, round(CASE WHEN spike THEN (b + a) / 2 ELSE v END, 6) AS v, round(CASE WHEN spike THEN (nb + na) / 2 ELSE nir END, 6) AS nir FROM s")
def despike(obs: DataFrame) -> DataFrame:
    return rounded(X.despike(annual(obs), "v", 0.03, ["v", "nir"], ["px"], ["yr"]), ["px", "yr"], ["v", "nir"])


INTERP = """WITH d AS (SELECT px, t, avg(nir) AS nir FROM (SELECT px, t, CASE WHEN ln IN (1, 4) THEN nir END AS nir FROM obs) GROUP BY px, t),
w AS (SELECT *, epoch(t)::BIGINT AS ts FROM d),
b AS (SELECT px, t, ts, nir, last_value(CASE WHEN nir IS NOT NULL THEN ts END IGNORE NULLS) OVER bk AS b_at, last_value(nir IGNORE NULLS) OVER bk AS b_v,
 first_value(CASE WHEN nir IS NOT NULL THEN ts END IGNORE NULLS) OVER ah AS a_at, first_value(nir IGNORE NULLS) OVER ah AS a_v FROM w
 WINDOW bk AS (PARTITION BY px ORDER BY ts RANGE BETWEEN 2764800 PRECEDING AND CURRENT ROW), ah AS (PARTITION BY px ORDER BY ts RANGE BETWEEN CURRENT ROW AND 2764800 FOLLOWING))
SELECT px, ts AS sec, round(coalesce(nir, b_v + (a_v - b_v) * coalesce((ts - b_at)::DOUBLE / NULLIF(a_at - b_at, 0)::DOUBLE, 0), b_v, a_v), 9) AS nir FROM b"""


@obs_query(INTERP)
def linear_interp(obs: DataFrame) -> DataFrame:
    rows = obs.withColumn("nir", F.when(F.col("ln").isin(1, 4), F.col("nir"))).groupBy("px", "t").agg(F.avg("nir").alias("nir"))
    out = X.linear_interpolation(rows, ["nir"], ["px"])
    return out.select("px", F.unix_timestamp(F.col("t").cast("timestamp")).alias("sec"), F.round("nir", 9).alias("nir"))


@obs_query(f"WITH {ANNUAL}, n AS (SELECT px, yr, v - (lag(v) OVER w + 1e-6::DOUBLE) AS s, row_number() OVER w AS k FROM ann WINDOW w AS (PARTITION BY px ORDER BY yr)) SELECT px, yr, round(s, 6) AS v_slope FROM n WHERE k > 1")
def pairwise_slope(obs: DataFrame) -> DataFrame:
    return rounded(X.pairwise(annual(obs), ["v"], ["px"], "yr"), ["px", "yr"], ["v_slope"])


@obs_query(f"WITH {ANNUAL} SELECT px, yr, CASE WHEN v * -1 > -0.3::DOUBLE THEN yr END AS v_change FROM ann")
def threshold_change(obs: DataFrame) -> DataFrame:
    return annual(obs).select("px", "yr", X.threshold(F.col("v"), F.col("yr"), -0.3, -1).alias("v_change"))


@obs_query(f"WITH {ANNUAL} SELECT px, yr, CASE WHEN v * -1 > -0.35::DOUBLE AND v * -1 < -0.25::DOUBLE THEN yr END AS v_change FROM ann")
def threshold_subtle(obs: DataFrame) -> DataFrame:
    return annual(obs).select("px", "yr", X.threshold_subtle(F.col("v"), F.col("yr"), -0.35, -0.25, -1).alias("v_change"))


@obs_query("""WITH a AS (SELECT px, quantile_cont(nir, 0.5) AS nir, quantile_cont(red, 0.5) AS red FROM obs WHERE yr <= 1997 GROUP BY px), b AS (SELECT px, quantile_cont(nir, 0.5) AS nir, quantile_cont(red, 0.5) AS red FROM obs WHERE yr >= 1998 GROUP BY px),
d AS (SELECT px, b.nir - a.nir AS nir_diff, b.red - a.red AS red_diff FROM a JOIN b USING (px)), l AS (SELECT *, (nir_diff * -1 > 0.01)::INTEGER + (red_diff > 0.01)::INTEGER AS n FROM d)
SELECT px, round(nir_diff, 6) AS nir_diff, round(red_diff, 6) AS red_diff, (n > 0)::INTEGER AS loss_any, (n = 2)::INTEGER AS loss_all, (n * 2 > 2)::INTEGER AS loss_mode FROM l""")
def two_date_change(obs: DataFrame) -> DataFrame:
    pct = lambda df: df.groupBy("px").agg(*[F.percentile(b, 0.5).alias(b) for b in ("nir", "red")])
    out = X.two_dates(pct(obs.where("yr <= 1997")), pct(obs.where("yr >= 1998")), ["nir", "red"], {"nir": 0.01, "red": 0.01}, I.CHANGE_DIRECTION)
    return rounded(out, ["px", "loss_any", "loss_all", "loss_mode"], ["nir_diff", "red_diff"])


ZT = """WITH w AS (SELECT y::INTEGER AS year, d::INTEGER AS day0, (d + 50)::INTEGER AS day1, y - 4 AS b0, y - 2 AS b1, y - 4 AS t0 FROM range(1999, 2002) a(y), range(100, 251, 50) b(d)),
m AS (SELECT px, year, day0, day1, yr, nir, yr BETWEEN b0 AND b1 AS base, yr = year AS now, yr >= t0 AS trend, yr + doy::DOUBLE / 365::DOUBLE - 2000 AS x FROM obs JOIN w ON doy BETWEEN day0 AND day1 AND yr BETWEEN least(b0, t0) AND year),
g AS (SELECT px, year, day0, day1, count(nir) FILTER (WHERE base) AS n, avg(nir) FILTER (WHERE base) AS mu, stddev_pop(nir) FILTER (WHERE base) AS sd, avg(nir) FILTER (WHERE now) AS x, regr_slope(nir, x) FILTER (WHERE trend) AS slope FROM m GROUP BY ALL)
"""


@obs_query(ZT + "SELECT px, year, day0, day1, round(CASE WHEN n >= 10 THEN (x - mu) / NULLIF(sd, 0) * 10 END, 4) AS \"nir_Z\", round(slope * 10000, 4) AS nir_slope FROM g")
def z_and_trend(obs: DataFrame) -> DataFrame:
    return rounded(X.z_and_trend(obs, ["nir"], (1995, 2001), (100, 300), 50, 3, 1, 5, 10), ["px", "year", "day0", "day1"], ["nir_Z", "nir_slope"], 4)


@obs_query(ZT + "SELECT px, year, day0, CASE WHEN (CASE WHEN n >= 10 THEN (x - mu) / NULLIF(sd, 0) * 10 END) * -1 > 5 THEN year END AS \"nir_Z_change\", CASE WHEN slope * 10000 * -1 > 200 THEN year END AS nir_slope_change FROM g")
def z_threshold(obs: DataFrame) -> DataFrame:
    out = X.z_and_trend(obs, ["nir"], (1995, 2001), (100, 300), 50, 3, 1, 5, 10)
    return X.threshold_z_and_trend(out, ["nir"], -0.5, -0.02).select("px", "year", "day0", "nir_Z_change", "nir_slope_change")


# ---- regression

X98 = "(yr + doy::DOUBLE / 365::DOUBLE - 1998)"


def _x() -> "F.Column":
    return F.col("yr").cast("double") + F.col("doy").cast("double") / B.dbl(365)


@obs_query(f"SELECT px, {rounded_sql({'nir_slope': f'regr_slope(nir, {X98})', 'nir_intercept': f'regr_intercept(nir, {X98})'})} FROM obs GROUP BY px")
def linear_fit(obs: DataFrame) -> DataFrame:
    return rounded(R.linear_fit(obs, ["nir"], ["px"], _x(), 1998), ["px"], ["nir_slope", "nir_intercept"])


@obs_query(f"WITH m AS (SELECT px, regr_slope(nir, {X98}) AS s, regr_intercept(nir, {X98}) AS i FROM obs GROUP BY px) SELECT {KEYS_SQL}, round(s * {X98} + i, 6) AS nir_trend FROM obs JOIN m USING (px)")
def linear_predict(obs: DataFrame) -> DataFrame:
    return rounded(R.linear_predict(obs, R.linear_fit(obs, ["nir"], ["px"], _x(), 1998), ["nir"], ["px"], _x(), 1998), KEYS, ["nir_trend"])


@obs_query(f"SELECT px, round(regr_r2(nir, {X98}), 6) AS r2 FROM obs GROUP BY px")
def r_squared(obs: DataFrame) -> DataFrame:
    fit = R.linear_predict(obs, R.linear_fit(obs, ["nir"], ["px"], _x(), 1998), ["nir"], ["px"], _x(), 1998)
    return rounded(R.r_squared(fit, "nir", "nir_trend", ["px"]), ["px"], ["r2"])


HARMONIC = f"""WITH h AS (SELECT px, nir AS y, sin({2 * pi!r}::DOUBLE * doy::DOUBLE / 365::DOUBLE) AS s, cos({2 * pi!r}::DOUBLE * doy::DOUBLE / 365::DOUBLE) AS c FROM obs),
m AS (SELECT px, avg(y) AS my, avg(s) AS ms, avg(c) AS mc, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(s, c) AS sc, covar_pop(s, y) AS sy, covar_pop(c, y) AS cy FROM h GROUP BY px),
b AS (SELECT px, my, ms, mc, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS bs, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS bc FROM m) """


def _harmonic(obs: DataFrame) -> DataFrame:
    return R.harmonic_fit(obs, ["nir"], ["px"], F.col("doy").cast("double") / B.dbl(365))


@obs_query(HARMONIC + "SELECT px, round(my - bs * ms - bc * mc, 6) AS nir_intercept, round(bs, 6) AS nir_sin_200_year, round(bc, 6) AS nir_cos_200_year FROM b")
def harmonic_fit(obs: DataFrame) -> DataFrame:
    return rounded(_harmonic(obs), ["px"], ["nir_intercept", "nir_sin_200_year", "nir_cos_200_year"])


@obs_query(HARMONIC + f""", q AS (SELECT *, atan2(bs, bc) / {2 * pi!r}::DOUBLE AS pk0 FROM b)
SELECT px, round(2 * sqrt(bs * bs + bc * bc), 6) AS nir_amplitude, round((atan2(bs, bc) + {pi!r}::DOUBLE) / {2 * pi!r}::DOUBLE, 6) AS nir_phase, round(CASE WHEN pk0 < 0 THEN pk0 + 1 ELSE pk0 END, 6) AS nir_peak,
 round(sqrt(bs * bs + bc * bc) * 0.5 + (bc * sin({pi!r}::DOUBLE) - bs * (cos({pi!r}::DOUBLE) - 1)) / {2 * pi!r}::DOUBLE, 6) AS nir_auc FROM q""")
def phase_amplitude_peak(obs: DataFrame) -> DataFrame:
    out = R.phase_amplitude_peak(_harmonic(obs), ["nir"], 0.0, 0.5)
    return rounded(out, ["px"], ["nir_amplitude", "nir_phase", "nir_peak", "nir_auc"])


@obs_query(HARMONIC + f"SELECT px, d::INTEGER AS doy, round(my - bs * ms - bc * mc + bs * sin({2 * pi!r}::DOUBLE * d / 365::DOUBLE) + bc * cos({2 * pi!r}::DOUBLE * d / 365::DOUBLE), 6) AS value FROM b, range(0, 365, 30) r(d)")
def synth_image(obs: DataFrame) -> DataFrame:
    rows = _harmonic(obs).withColumn("doy", F.explode(F.sequence(F.lit(0), F.lit(364), F.lit(30))))
    return rows.select("px", "doy", F.round(R.harmonic_value("nir", F.col("doy").cast("double") / B.dbl(365)), 6).alias("value"))


# ---- segments: the turning points of yearly medians stand for vertices, turned so that loss goes up

VERTS = (
    f"{ANNUAL}, vt AS (SELECT px, yr, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM ann WINDOW w AS (PARTITION BY px ORDER BY yr)), "
    "vx AS (SELECT px, yr, -v AS fit, row_number() OVER (PARTITION BY px ORDER BY yr) AS k FROM vt WHERE b IS NULL OR a IS NULL OR (v - b) * (a - v) <= 0)"
)
SEGS = VERTS + ", sg AS (SELECT px, yr, yr - lag(yr) OVER w AS dur, lag(fit) OVER w - fit AS mag, (lag(fit) OVER w - fit) / (yr - lag(yr) OVER w) AS slope, lag(yr) OVER w AS start, lag(fit) OVER w AS start_fit, fit AS end_fit FROM vx WINDOW w AS (PARTITION BY px ORDER BY yr) QUALIFY start IS NOT NULL)"


def verts(obs: DataFrame) -> DataFrame:
    over = Window.partitionBy("px").orderBy("yr")
    rows = annual(obs).withColumns({"_b": F.lag("v").over(over), "_a": F.lead("v").over(over)})
    rows = rows.where("_b IS NULL OR _a IS NULL OR (v - _b) * (_a - v) <= 0").select("px", "yr", (-F.col("v")).alias("fit"))
    return rows.groupBy("px").agg(F.sort_array(F.collect_list(F.struct("yr", "fit"))).alias("verts"))


@obs_query(f"WITH {SEGS} SELECT px, yr, dur::INTEGER AS dur, start, {rounded_sql(['mag', 'slope'])} FROM sg")
def vertices_to_segments(obs: DataFrame) -> DataFrame:
    rows = verts(obs).select("px", F.explode(S.segments(F.col("verts"))).alias("s"))
    return rounded(rows.select("px", "s.*"), ["px", "yr", "dur", "start"], ["mag", "slope"])


def _loss_gain_sql(choice: str) -> str:
    parts = []
    for kind in ("loss", "gain"):
        field, desc = S.CHOICES[kind][choice]
        test = "mag <= -0.02 OR slope <= -0.01" if kind == "loss" else "mag >= 0.02 OR slope >= 0.01"
        parts.append(f"{kind} AS (SELECT px, yr, dur, mag, slope, row_number() OVER (PARTITION BY px ORDER BY {field} {'DESC' if desc else 'ASC'}, yr) AS k FROM sg WHERE {test})")
    out = ", ".join(f"max(CASE WHEN {k}.k = {i} THEN {('round(' + k + '.' + f + ', 6)') if f in ('mag', 'slope') else k + '.' + f + '::INTEGER'} END) AS {k}_{f}_{i}" for k in ("loss", "gain") for i in (1, 2) for f in ("yr", "dur", "mag", "slope"))
    return f"WITH {SEGS}, {parts[0]}, {parts[1]} SELECT p.px, {out} FROM (SELECT DISTINCT px FROM vx) p LEFT JOIN loss ON loss.px = p.px LEFT JOIN gain ON gain.px = p.px GROUP BY p.px"


def _loss_gain(choice: str):
    def run(obs: DataFrame) -> DataFrame:
        v = F.col("verts")
        wide = {}
        for kind, m, s in (("loss", -0.02, -0.01), ("gain", 0.02, 0.01)):
            wide |= S.top(S.loss_gain(v, kind, choice, m, s), 2, kind)
        return verts(obs).select("px", *[(F.round(c, 6) if "_mag_" in n or "_slope_" in n else c).alias(n) for n, c in wide.items()])

    run.__name__ = f"loss_gain_{choice}"
    run.__doc__ = f"The two {choice} losses and gains of each pixel."
    return run


for _choice in ("largest", "newest", "steepest", "longest"):
    obs_query(_loss_gain_sql(_choice))(_loss_gain(_choice))


@obs_query(f"""WITH {SEGS}, d AS (SELECT px, start + 1 AS yod, -mag AS mag, dur, -start_fit AS preval, row_number() OVER (PARTITION BY px ORDER BY -mag DESC, start) AS k FROM sg WHERE -mag >= 0.02 OR (dur >= 15 AND -mag >= 0.01))
SELECT p.px, {', '.join(f"max(CASE WHEN k = {i} THEN {('round(' + c + ', 6)') if c in ('mag', 'preval') else c + '::INTEGER'} END) AS {c}_{i}" for i in (1, 2, 3) for c in ('yod', 'mag', 'dur', 'preval'))} FROM (SELECT DISTINCT px FROM vx) p LEFT JOIN d ON d.px = p.px GROUP BY p.px""")
def extract_disturbance(obs: DataFrame) -> DataFrame:
    wide = S.disturbances(F.col("verts"), 0.02, 0.01)
    return verts(obs).select("px", *[(F.round(c, 6) if n.startswith(("mag", "preval")) else c).alias(n) for n, c in wide.items()])


def _kept(slot: int, mmu: int) -> str:
    """s{slot}: pixels in a patch of ``mmu`` cells or more with one year in a slot, joined over corners."""
    return f"""c{slot} AS (SELECT px, px // 10 AS row, px % 10 AS col, yod FROM d WHERE k = {slot}),
e{slot} AS (SELECT a.px AS a, b.px AS b FROM c{slot} a JOIN c{slot} b ON a.yod = b.yod AND a.px <> b.px AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
r{slot} AS (SELECT px, px AS root FROM c{slot} UNION SELECT e.b, r.root FROM r{slot} r JOIN e{slot} e ON e.a = r.px), s{slot} AS (SELECT px FROM r{slot} GROUP BY px HAVING count(*) >= {mmu})"""


@obs_query(f"""WITH RECURSIVE {SEGS}, d AS (SELECT px, start + 1 AS yod, -mag AS mag, row_number() OVER (PARTITION BY px ORDER BY -mag DESC, start) AS k FROM sg WHERE -mag >= 0.02 OR (dur >= 15 AND -mag >= 0.01)), {_kept(1, 3)}, {_kept(2, 3)}
SELECT p.px, {', '.join(f"max(CASE WHEN k = {i} AND s{i}.px IS NOT NULL THEN {c} END) AS {c}_{i}" for i in (1, 2) for c in ('yod', 'round(mag, 6)')).replace('AS round(mag, 6)', 'AS mag')}
FROM (SELECT DISTINCT px FROM vx) p LEFT JOIN d ON d.px = p.px LEFT JOIN s1 ON s1.px = p.px LEFT JOIN s2 ON s2.px = p.px GROUP BY p.px""".replace("AS yod_1", "::INTEGER AS yod_1").replace("AS yod_2", "::INTEGER AS yod_2"))
def disturbance_mmu(obs: DataFrame) -> DataFrame:
    """The two largest disturbances of each pixel, of those years that connected pixels share over three cells at least."""
    wide = verts(obs).select("px", (F.col("px") / 10).cast("long").alias("row"), (F.col("px") % 10).alias("col"), *[c.alias(n) for n, c in S.disturbances(F.col("verts"), 0.02, 0.01, 2).items()])
    out = patches.disturbances_at_least(wide, 3, 2)
    return out.select("px", *[F.round(f"{f}_{i}", 6).alias(f"{f}_{i}") if f == "mag" else F.col(f"{f}_{i}") for i in (1, 2) for f in ("yod", "mag")])


@obs_query(f"WITH {SEGS} SELECT px, y::INTEGER AS year, dur::INTEGER AS dur, round(end_fit - (end_fit - start_fit) / dur * (yr - y), 6) AS fit, round(end_fit - start_fit, 6) AS mag, round((end_fit - start_fit) / dur, 6) AS slope, round(end_fit - (end_fit - start_fit) / dur * (yr - y) - start_fit, 6) AS diff FROM sg, range(1995, 2002) r(y) WHERE (y > start OR (y = 1995 AND start = 1995)) AND y <= yr")
def fit_stack_annual(obs: DataFrame) -> DataFrame:
    return rounded(S.annual_from_segments(verts(obs), "verts", 1995, 2001, ["px"]), ["px", "year", "dur"], ["fit", "mag", "slope", "diff"])


@obs_query(f"WITH {SEGS} SELECT p.px, y::INTEGER AS year, round(max(CASE WHEN y BETWEEN start AND yr THEN end_fit + (start_fit - end_fit) / dur * (yr - y) END), 6) AS fit FROM (SELECT DISTINCT px FROM vx) p CROSS JOIN range(1994, 2003) r(y) LEFT JOIN sg ON sg.px = p.px GROUP BY 1, 2")
def lt_annual_fit(obs: DataFrame) -> DataFrame:
    return rounded(S.annual_fit(verts(obs), "verts", 1994, 2002, ["px"]), ["px", "year"], ["fit"])


@obs_query(f"WITH {VERTS} SELECT px, {', '.join(f'coalesce(max(CASE WHEN k = {i} THEN yr END), -32768)::INTEGER AS yrs_{i}, round(coalesce(max(CASE WHEN k = {i} THEN fit END), -32768), 6) AS fit_{i}' for i in range(1, 7))} FROM vx GROUP BY px")
def vert_stack_pad(obs: DataFrame) -> DataFrame:
    wide = S.padded(F.col("verts"), 6)
    return verts(obs).select("px", *[(F.round(c, 6) if n.startswith("fit") else c).alias(n) for n, c in wide.items()])


# ---- continuous-change models with three segments, cut at 1997 and 1999

CCDC = """sg3 AS (SELECT px, k, [1995.0, 1997.0, 1999.0][k]::DOUBLE AS a, [1996.9, 1998.9, 2001.9][k]::DOUBLE AS b, [1997.0, 1999.0, 0.0][k]::DOUBLE AS brk, [1.0, 1.0, 0.0][k]::DOUBLE AS prob,
 avg(nir) AS intp, avg(red) / 1000 AS slp, avg(blue) AS cos1, avg(green) AS sin1, avg(swir1) - avg(swir2) AS mag FROM (SELECT *, CASE WHEN yr < 1997 THEN 1 WHEN yr < 1999 THEN 2 ELSE 3 END AS k FROM obs) GROUP BY px, k)"""


def ccdc_synth(obs: DataFrame) -> DataFrame:
    k = F.when(F.col("yr") < 1997, 1).when(F.col("yr") < 1999, 2).otherwise(3)
    nth = lambda *xs: F.element_at(F.array(*[B.dbl(x) for x in xs]), F.col("k"))
    g = obs.withColumn("k", k).groupBy("px", "k").agg(F.avg("nir").alias("i"), F.avg("red").alias("s"), F.avg("blue").alias("c1"), F.avg("green").alias("s1"), (F.avg("swir1") - F.avg("swir2")).alias("mag"))
    coefs = F.array("i", F.col("s") / 1000, "c1", "s1", *[B.dbl(0)] * 4)
    seg = F.struct("k", nth(1995, 1997, 1999).alias("tStart"), nth(1996.9, 1998.9, 2001.9).alias("tEnd"), nth(1997, 1999, 0).alias("tBreak"), nth(1, 1, 0).alias("changeProb"), coefs.alias("coefs"), "mag")
    return g.groupBy("px").agg(F.sort_array(F.collect_list(seg)).alias("segs"))


VALUE = f"intp + slp * t + cos1 * cos({2 * pi!r}::DOUBLE * t) + sin1 * sin({2 * pi!r}::DOUBLE * t)"


@obs_query(f"WITH {CCDC}, tt AS (SELECT 1995::DOUBLE + i * 0.25::DOUBLE AS t FROM range(0, 28) r(i)) SELECT p.px, round(tt.t, 6) AS time, k::INTEGER AS k, round(mag, 6) AS mag FROM (SELECT DISTINCT px FROM sg3) p CROSS JOIN tt LEFT JOIN sg3 ON sg3.px = p.px AND a < t AND t <= b")
def ccdc_segment_pick(obs: DataFrame) -> DataFrame:
    rows = ccdc_synth(obs).withColumn("time", F.explode(C.time_series(1995, 2001, 0.25)))
    s = C.pick(F.col("segs"), F.col("time"))
    return rows.select("px", F.round("time", 6).alias("time"), s["k"].alias("k"), F.round(s["mag"], 6).alias("mag"))


@obs_query(f"""WITH {CCDC}, tt AS (SELECT 1995::DOUBLE + i * 0.25::DOUBLE AS t FROM range(0, 28) r(i)), st AS (SELECT *, CASE WHEN k = 1 THEN a ELSE [1997.0, 1999.0][k - 1]::DOUBLE END AS lo, CASE WHEN k = 3 THEN b ELSE brk END AS hi FROM sg3)
SELECT p.px, round(tt.t, 6) AS time, round({VALUE}, 6) AS predicted FROM (SELECT DISTINCT px FROM sg3) p CROSS JOIN tt LEFT JOIN st ON st.px = p.px AND lo < t AND t <= hi""")
def ccdc_predict(obs: DataFrame) -> DataFrame:
    return rounded(C.predict(ccdc_synth(obs), "segs", C.time_series(1995, 2001, 0.25), ["px"], True), ["px"], ["time", "predicted"])


@obs_query(f"""WITH {CCDC}, yy AS (SELECT y::INTEGER AS year, y + 243.5::DOUBLE / 365::DOUBLE AS t FROM range(1995, 2002) r(y)), st AS (SELECT *, CASE WHEN k = 1 THEN a ELSE [1997.0, 1999.0][k - 1]::DOUBLE END AS lo, CASE WHEN k = 3 THEN b ELSE brk END AS hi FROM sg3),
f AS (SELECT p.px, year, intp + slp * t AS fitted FROM (SELECT DISTINCT px FROM sg3) p CROSS JOIN yy LEFT JOIN st ON st.px = p.px AND lo < t AND t <= hi), g AS (SELECT *, fitted - lag(fitted) OVER (PARTITION BY px ORDER BY year) AS s FROM f)
SELECT px, year, round(fitted, 6) AS fitted, round(s, 6) AS fit_slope FROM g WHERE year > 1995""")
def ccdc_annual_slope(obs: DataFrame) -> DataFrame:
    return rounded(C.annualize(ccdc_synth(obs), "segs", 1995, 2001, ["px"]), ["px", "year"], ["fitted", "fit_slope"])


@obs_query(f"""WITH {CCDC}, s AS (SELECT px, brk, mag, prob, CASE WHEN mag < 0 THEN 'loss' ELSE 'gain' END AS kind FROM sg3 WHERE mag <> 0)
SELECT p.px, {', '.join(f"CASE WHEN arg_max(prob, {o}) FILTER (WHERE kind = '{k}') >= 1 THEN round(arg_max({c}, {o}) FILTER (WHERE kind = '{k}'), 6) END AS {w}_{k}_{n}" for k in ('loss', 'gain') for w, o in (('newest', 'brk'), ('largest', 'abs(mag)')) for n, c in (('year', 'brk'), ('mag', 's.mag')))}
FROM (SELECT DISTINCT px FROM sg3) p LEFT JOIN s ON s.px = p.px GROUP BY p.px""")
def ccdc_change(obs: DataFrame) -> DataFrame:
    return rounded(ccdc_synth(obs), ["px"], C.changes(F.col("segs")))


@obs_query(f"""WITH {ANNUAL}, d AS (SELECT px, max(CASE WHEN v < 0.3 THEN yr END) AS yod, avg(nir) * 40 AS cover, avg(red) * 40 AS height FROM ann GROUP BY px)
SELECT px, CASE WHEN cover >= 10 AND height >= 5 THEN coalesce(CASE WHEN yod < 2001 THEN least(2001 - yod, 20) ELSE 20 END, 20)::INTEGER END AS age FROM d""")
def stand_age(obs: DataFrame) -> DataFrame:
    d = annual(obs).groupBy("px").agg(F.max(F.when(F.col("v") < 0.3, F.col("yr"))).alias("yod"), (F.avg("nir") * 40).alias("cover"), (F.avg("red") * 40).alias("height"))
    return d.select("px", S.stand_age(2001, F.col("yod"), F.col("cover"), F.col("height")).cast("int").alias("age"))


@obs_query(f"""WITH RECURSIVE {ANNUAL}, d AS (SELECT px, max(CASE WHEN v < 0.3 THEN yr END) AS yod, avg(nir) * 40 AS cover, avg(red) * 40 AS height FROM ann GROUP BY px),
s AS (SELECT px, px // 10 AS row, px % 10 AS col, CASE WHEN cover >= 11 AND height >= 10 THEN coalesce(CASE WHEN yod < 2001 THEN least(2001 - yod, 20) ELSE 20 END, 20)::INTEGER END AS age FROM d),
e AS (SELECT a.px AS a, b.px AS b FROM s a JOIN s b ON a.age IS NOT NULL AND b.age IS NOT NULL AND a.px <> b.px AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
r AS (SELECT px, px AS root FROM s WHERE age IS NOT NULL UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.px), n AS (SELECT px FROM r GROUP BY px HAVING count(*) >= 4)
SELECT px, age, CASE WHEN n.px IS NOT NULL THEN age END AS mmu_age FROM s LEFT JOIN n USING (px)""")
def stand_age_mmu(obs: DataFrame) -> DataFrame:
    """Ages of stands, and of those in connected forest of four cells at least."""
    d = annual(obs).groupBy("px").agg(F.max(F.when(F.col("v") < 0.3, F.col("yr"))).alias("yod"), (F.avg("nir") * 40).alias("cover"), (F.avg("red") * 40).alias("height"))
    rows = d.select("px", (F.col("px") / 10).cast("long").alias("row"), (F.col("px") % 10).alias("col"), S.stand_age(2001, F.col("yod"), F.col("cover"), F.col("height"), 10, 11).cast("int").alias("age"))
    return patches.stand_age_at_least(rows, "age", 4).select("px", "age", "mmu_age")
