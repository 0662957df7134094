"""Queries of the smaller operators: packing, scaling, alignment in time, product joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.functions import ccdc as C
from rastertime.functions import dates as D
from rastertime.functions import masks as M
from rastertime.functions import segments as S
from rastertime.operators import change as X
from rastertime.operators import composite as P
from rastertime.operators import joins as J
from rastertime.plans.history import ANNUAL, CCDC, VALUE, SEGS, VERTS, annual, ccdc_synth, verts
from rastertime.plans.registry import KEYS, KEYS_SQL, obs_query, rounded
from rastertime.sources.catalog import radar
from rastertime.sources.sinks import pack


@obs_query(f"SELECT {KEYS_SQL} FROM obs WHERE orbit = 'F' AND (sensor = 'A' OR sensor = 'N') AND ln <> 4")
def radar_filter(obs: DataFrame) -> DataFrame:
    kinds = F.when(F.col("sensor").isin("A", "N"), F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("HH")))
    rows = obs.withColumns({"instrumentMode": F.when(F.col("ln") == 4, "EW").otherwise("IW"), "polarisations": kinds, "pass": F.when(F.col("orbit") == "F", "ASCENDING").otherwise("DESCENDING")})
    return radar(rows, "VH", "ASCENDING").select(*KEYS)


@obs_query("""WITH a AS (SELECT px, yr, doy, avg(nir) AS nir FROM obs WHERE sensor = 'A' GROUP BY ALL), n AS (SELECT px, yr, doy, avg(red) AS red FROM obs WHERE sensor = 'N' GROUP BY ALL), r AS (SELECT px, yr, doy, max(temp) AS temp FROM obs WHERE sensor = 'R' GROUP BY ALL)
SELECT px, yr, doy, round(nir, 9) AS nir, round(red, 9) AS red, temp FROM a JOIN n USING (px, yr, doy) LEFT JOIN r USING (px, yr, doy)""")
def join_products(obs: DataFrame) -> DataFrame:
    on = ["px", "yr", "doy"]
    part = lambda s, e: obs.where(F.col("sensor") == s).groupBy(*on).agg(e)
    parts = {"fine": part("A", F.avg("nir").alias("nir")), "middle": part("N", F.avg("red").alias("red")), "thermal": part("R", F.max("temp").alias("temp"))}
    return rounded(J.by_time(parts, on, ("thermal",)).select(*on, "temp", "nir", "red"), [*on, "temp"], ["nir", "red"], 9)


@obs_query(f"""WITH {SEGS}, l AS (SELECT px, yr, dur, mag, slope, row_number() OVER (PARTITION BY px ORDER BY mag, yr) AS k FROM sg WHERE mag <= -0.02 OR slope <= -0.01)
SELECT p.px, coalesce(max(yr), -32768)::SMALLINT AS loss_yr, coalesce(max(dur), -32768)::SMALLINT AS loss_dur, coalesce(trunc(max(round(mag, 9)) * 10000), -32768)::SMALLINT AS loss_mag FROM (SELECT DISTINCT px FROM vx) p LEFT JOIN l ON l.px = p.px AND k = 1 GROUP BY p.px""")
def lt_export_prep(obs: DataFrame) -> DataFrame:
    wide = S.top(S.loss_gain(F.col("verts"), "loss", "largest", -0.02, -0.01), 1, "loss", ("yr", "dur", "mag"))
    rows = verts(obs).select("px", *[(F.round(c, 9) if "mag" in n else c).alias(n.removesuffix("_1")) for n, c in wide.items()])
    packed = pack(rows, ["loss_yr", "loss_dur", "loss_mag"], keep=("loss_yr", "loss_dur"))
    return packed.select("px", *[F.coalesce(F.col(c), F.lit(B.NO_DATA).cast("short")).alias(c) for c in ("loss_yr", "loss_dur", "loss_mag")])


@obs_query(f"WITH {ANNUAL} SELECT px, yr, round((v * 1::DOUBLE + 1) * 100, 6) AS scaled, round(v, 9) AS back FROM ann")
def fit_scaling(obs: DataFrame) -> DataFrame:
    s = B.scale_for_fit(F.col("v"), -1, 100)
    return annual(obs).select("px", "yr", F.round(s, 6).alias("scaled"), F.round(B.unscale_fit(s, -1, 100), 9).alias("back"))


@obs_query(f"WITH {ANNUAL}, n AS (SELECT *, lag(yr) OVER w AS y0, lead(yr) OVER w AS y1, lag(v) OVER w AS b, lead(v) OVER w AS a FROM ann WINDOW w AS (PARTITION BY px ORDER BY yr)) SELECT px, yr, round(CASE WHEN yr = 1998 AND y0 = 1997 AND y1 = 1999 THEN (b + a) / 2 ELSE v END, 9) AS v FROM n")
def bridge_year(obs: DataFrame) -> DataFrame:
    return rounded(X.bridge_year(annual(obs), "v", 1998, ["px"]), ["px", "yr"], ["v"], 9)


@obs_query(f"WITH {ANNUAL} SELECT px, yr, round(CASE WHEN count(w) OVER (PARTITION BY px) >= 4 THEN w END, 9) AS v FROM (SELECT px, yr, CASE WHEN v > 0.28 THEN v END AS w FROM ann)")
def least_observations(obs: DataFrame) -> DataFrame:
    rows = annual(obs).withColumn("v", F.when(F.col("v") > 0.28, F.col("v")))
    return rounded(X.least_observations(rows, "v", ["px"], 4), ["px", "yr"], ["v"], 9)


@obs_query("""WITH c AS (SELECT px, yr AS year, CASE WHEN px % 3 <> 0 OR yr <> 1997 THEN min(doy) END AS j FROM obs GROUP BY px, yr), f AS (SELECT px, year, coalesce(j, median(j) OVER (PARTITION BY px))::DOUBLE AS d FROM c)
SELECT px, year, round(year + CASE WHEN d <= 3 THEN 1 ELSE 0 END + d / 365, 9) AS time FROM f""")
def composite_times(obs: DataFrame) -> DataFrame:
    rows = obs.groupBy("px", F.col("yr").alias("year")).agg(F.min("doy").alias("julianDay"))
    rows = rows.withColumn("julianDay", F.when((F.col("px") % 3 != 0) | (F.col("year") != 1997), F.col("julianDay")))
    return rounded(X.composite_times(rows, ["px"], 3), ["px", "year"], ["time"], 9)


@obs_query(f"""WITH {CCDC}, y AS (SELECT y::INTEGER AS year, y + 250::DOUBLE / 365::DOUBLE AS t FROM range(1995, 2002) r(y)), n AS (SELECT px, year, t, intp, slp, a, b, row_number() OVER (PARTITION BY px, year ORDER BY a DESC) AS nth FROM sg3 JOIN y ON a < t AND b >= t - 1)
SELECT p.px, y.year, round(intp + slp * n.t, 9) AS fit, round(slp, 9) AS slope, round(slp * (b - a), 9) AS mag FROM (SELECT DISTINCT px FROM sg3) p CROSS JOIN y LEFT JOIN n ON n.px = p.px AND n.year = y.year AND nth = 1""")
def ccdc_annual_segments(obs: DataFrame) -> DataFrame:
    return rounded(C.annual_segments(ccdc_synth(obs), "segs", 1995, 2001, ["px"]), ["px", "year"], ["fit", "slope", "mag"], 9)


@obs_query(f"SELECT {KEYS_SQL}, round(abs(nir - quantile_cont(nir, 0.75) OVER (PARTITION BY px, yr)) * -1, 9) AS delta FROM obs")
def absolute_difference(obs: DataFrame) -> DataFrame:
    return rounded(P.absolute_difference(obs, ["px", "yr"], "nir", 75), KEYS, ["delta"], 9)


@obs_query(f"WITH {ANNUAL} SELECT px, CASE WHEN max(CASE WHEN v < 0.28 THEN yr END) BETWEEN 1996 AND 1999 THEN max(CASE WHEN v < 0.28 THEN yr END) END AS lost FROM ann GROUP BY px")
def existing_change(obs: DataFrame) -> DataFrame:
    known = annual(obs).groupBy("px").agg(F.max(F.when(F.col("v") < 0.28, F.col("yr"))).alias("y"))
    return known.select("px", M.existing_change(F.col("y"), 1996, 1999).alias("lost"))


@obs_query(f"SELECT {KEYS_SQL}, round(radians(90 - (temp - 240)), 9) AS zenith, round(radians(doy), 9) AS azimuth FROM obs")
def sun_angles(obs: DataFrame) -> DataFrame:
    return rounded(obs, KEYS, D.sun_angles(F.col("temp") - 240, F.col("doy").cast("double")), 9)


@obs_query(f"WITH {VERTS} SELECT px, y::INTEGER AS year, round(max(CASE WHEN vx.yr = y THEN fit END), 9) AS fit FROM vx, range(1995, 2002) r(y) GROUP BY px, y")
def array_to_series(obs: DataFrame) -> DataFrame:
    rows = verts(obs).select("px", F.transform("verts", lambda p: p["yr"]).alias("ys"), F.transform("verts", lambda p: p["fit"]).alias("vs"))
    return rounded(S.array_to_series(rows, "vs", "ys", list(range(1995, 2002)), ["px"], "fit"), ["px", "year"], ["fit"], 9)


@obs_query(f"SELECT {KEYS_SQL}, CASE WHEN ((pk * 64) & 1024) = 0 AND ln % 4 > 0 THEN nir END AS nir FROM obs")
def modis_state_mask(obs: DataFrame) -> DataFrame:
    keep = M.state_clear(F.col("pk") * 64) & M.observed(F.col("ln") % 4)
    return B.mask(obs, keep, ["nir"]).select(*KEYS, "nir")


_STRETCHED = "st AS (SELECT *, CASE WHEN k = 1 THEN a ELSE [1997.0, 1999.0][k - 1]::DOUBLE END AS lo, CASE WHEN k = 3 THEN b ELSE brk END AS hi FROM sg3)"


@obs_query(f"""WITH {CCDC}, yy AS (SELECT y::INTEGER AS year, y + 243.5::DOUBLE / 365::DOUBLE AS t FROM range(1995, 2002) r(y)), {_STRETCHED},
f AS (SELECT p.px, year, {VALUE} AS fitted FROM (SELECT DISTINCT px FROM sg3) p CROSS JOIN yy LEFT JOIN st ON st.px = p.px AND lo < t AND t <= hi), g AS (SELECT *, fitted - lag(fitted) OVER (PARTITION BY px ORDER BY year) AS s FROM f)
SELECT px, year, round(fitted, 6) AS fitted, round(s, 6) AS fit_slope FROM g WHERE year > 1995""")
def ccdc_annual_harmonic(obs: DataFrame) -> DataFrame:
    """The whole curve at one date of each year, and its change from the year before."""
    return rounded(C.annualize(ccdc_synth(obs), "segs", 1995, 2001, ["px"], harmonics=(1,)), ["px", "year"], ["fitted", "fit_slope"])


@obs_query(f"""WITH {CCDC}, {_STRETCHED}, tt AS (SELECT px, yr AS year, yr + min(doy)::DOUBLE / 365::DOUBLE AS t FROM obs WHERE px % 7 > 0 GROUP BY px, yr),
f AS (SELECT tt.px, year, t, intp + slp * t AS fitted FROM tt LEFT JOIN st ON st.px = tt.px AND lo < t AND t <= hi), g AS (SELECT *, fitted - lag(fitted) OVER w AS s, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY px ORDER BY year))
SELECT px, year, round(t, 6) AS time, round(fitted, 6) AS fitted, round(s, 6) AS fit_slope FROM g WHERE n > 1""")
def ccdc_annual_composites(obs: DataFrame) -> DataFrame:
    """The trend at the date of each pixel's composite."""
    times = obs.where("px % 7 > 0").groupBy("px", F.col("yr").alias("year")).agg((F.col("yr") + F.min("doy").cast("double") / 365).alias("time"))
    return rounded(C.annualize_at(ccdc_synth(obs), "segs", times, ["px"]), ["px", "year"], ["time", "fitted", "fit_slope"])
