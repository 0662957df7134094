"""Queries on single observations: filters, band arithmetic, indices, masks, harmonisation."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.functions import dates as D
from rastertime.functions import harmonize as H
from rastertime.functions import indices as I
from rastertime.functions import masks as M
from rastertime.plans.registry import KEYS, KEYS_SQL, obs_query, query, rounded, rounded_sql
from rastertime.sources.catalog import SENSOR_CODES, in_box, merge
from rastertime.sources.observations import BANDS, table


def nd(a: str, b: str) -> str:
    return f"({a} - {b}) / NULLIF({a} + {b}, 0)"


@obs_query(f"SELECT {KEYS_SQL}, sensor FROM obs WHERE t >= TIMESTAMP '1997-03-01' AND t < TIMESTAMP '1999-03-01' AND yr BETWEEN 1997 AND 1998")
def scan_filter_calendar(obs: DataFrame) -> DataFrame:
    return obs.where(D.in_dates(F.col("t"), "1997-03-01", "1999-03-01") & D.in_years(F.col("t"), 1997, 1998)).select(*KEYS, "sensor")


@obs_query(f"SELECT {KEYS_SQL} FROM obs WHERE doy >= 300 OR doy <= 60")
def filter_doy_wrap(obs: DataFrame) -> DataFrame:
    return obs.where(D.in_days(F.col("doy"), 300, 60)).select(*KEYS)


@obs_query(f"SELECT {KEYS_SQL}, row, col FROM obs WHERE row BETWEEN 1 AND 4 AND col BETWEEN 2 AND 7")
def filter_bounds(obs: DataFrame) -> DataFrame:
    return in_box(obs, 1, 4, 2, 7).select(*KEYS, "row", "col")


@obs_query(f"SELECT {KEYS_SQL}, red AS b_red, swir1 AS b_swir1, swir2 AS b_swir2 FROM obs")
def band_select_rename(obs: DataFrame) -> DataFrame:
    found = B.select_bands(obs, "red", r"swir\d")
    return obs.select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in found])


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql({b: f'{b} * 2.75e-5::DOUBLE + (-0.2)::DOUBLE' for b in I.SIX} | {'temp': 'temp * 0.00341802::DOUBLE + 149::DOUBLE'}, 9)} FROM obs")
def scale_factors_c2(obs: DataFrame) -> DataFrame:
    return rounded(H.apply_scale(obs), KEYS, [*I.SIX, "temp"], 9)


def _lin(slopes, intercepts, forward: bool) -> dict[str, str]:
    return {b: f"{b} * {s}::DOUBLE + ({i})::DOUBLE" if forward else f"({b} - ({i})::DOUBLE) / {s}::DOUBLE" for b, s, i in zip(I.SIX, slopes, intercepts)}


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql(_lin(H.ROY_SLOPES, H.ROY_INTERCEPTS, False))} FROM obs")
def harmonize_roy(obs: DataFrame) -> DataFrame:
    return rounded(H.roy(obs), KEYS, I.SIX)


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql(_lin(*H.CHASTAIN['MSI', 'ETM'], False))} FROM obs")
def harmonize_chastain_msi_etm(obs: DataFrame) -> DataFrame:
    return rounded(H.chastain(obs, "MSI", "ETM"), KEYS, I.SIX)


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql(_lin(*H.CHASTAIN['OLI', 'ETM'], True), 10)} FROM obs")
def harmonize_inverse(obs: DataFrame) -> DataFrame:
    return rounded(H.chastain(obs, "ETM", "OLI"), KEYS, I.SIX, 10)


SIMPLE_SQL = {"NDVI": nd("nir", "red"), "NBR": nd("nir", "swir2"), "NDMI": nd("nir", "swir1"), "NDSI": nd("green", "swir1")}


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql(SIMPLE_SQL)} FROM obs")
def indices_simple(obs: DataFrame) -> DataFrame:
    return rounded(obs, KEYS, I.simple_indices())


EVI_SQL = "2.5::DOUBLE * ((nir - red) / NULLIF(nir + 6::DOUBLE * red - 7.5::DOUBLE * blue + 1::DOUBLE, 0))"
SAVI_SQL = "(nir - red) * 1.5::DOUBLE / NULLIF(nir + red + 0.5::DOUBLE, 0)"
IBI_A, IBI_B = "(2::DOUBLE * swir1 / NULLIF(swir1 + nir, 0))", "(nir / NULLIF(nir + red, 0) + green / NULLIF(green + swir1, 0))"
FULL_SQL = {f"ND_{a}_{b}": nd(a, b) for a, b in I.PAIRS} | {"R_swir1_nir": "swir1 / NULLIF(nir, 0)", "R_red_swir1": "red / NULLIF(swir1, 0)", "EVI": EVI_SQL, "SAVI": SAVI_SQL, "IBI": nd(IBI_A, IBI_B)}


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql(FULL_SQL)} FROM obs")
def indices_full(obs: DataFrame) -> DataFrame:
    return rounded(obs, KEYS, I.full_indices())


SOIL_SQL = {"NDCI": nd("red", "green"), "NDII": nd("red", "swir2"), "NDFI": nd("swir1", "nir"), "BSI": nd("(swir1 + red)", "(nir + blue)"), "HI": "swir1 / NULLIF(swir2, 0)"}


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql(SOIL_SQL)} FROM obs")
def indices_soil(obs: DataFrame) -> DataFrame:
    return rounded(obs, KEYS, I.soil_indices())


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql({'EVI': EVI_SQL, 'SAVI': SAVI_SQL, 'NIRv': '(' + nd('nir', 'red') + ' - 0.08::DOUBLE) * nir'})} FROM obs")
def indices_evi_savi_nirv(obs: DataFrame) -> DataFrame:
    return rounded(obs.withColumns(I.simple_indices()), KEYS, I.vegetation_indices())


def _tc(k: int, matrix=I.TOA_TRANSFORM) -> str:
    return " + ".join(f"{b} * ({w})::DOUBLE" for b, w in zip(I.SIX, matrix[k]))


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql({n: _tc(k) for k, n in enumerate(I.TRANSFORM_NAMES)})} FROM obs")
def tasseled_cap(obs: DataFrame) -> DataFrame:
    return rounded(obs, KEYS, I.tasseled_cap())


@obs_query(f"SELECT {KEYS_SQL}, {rounded_sql({n: _tc(k, I.TM_TRANSFORM) for k, n in enumerate(I.TRANSFORM_NAMES[:3])})} FROM obs")
def tasseled_cap_tm(obs: DataFrame) -> DataFrame:
    return rounded(obs, KEYS, I.tasseled_cap(3, I.TM_TRANSFORM))


TC_VIEW = f"tc AS (SELECT *, {_tc(0)} AS brightness, {_tc(1)} AS greenness, {_tc(2)} AS wetness FROM obs)"
_FULL = {"B": "brightness", "G": "greenness", "W": "wetness"}
ANGLES_SQL = {f"tcAngle{p}": f"atan2({_FULL[p[1]]}, {_FULL[p[0]]}) / {pi!r}::DOUBLE" for p in ("BG", "GW", "BW")} | {f"tcDist{p}": f"sqrt({_FULL[p[0]]} * {_FULL[p[0]]} + {_FULL[p[1]]} * {_FULL[p[1]]})" for p in ("BG", "GW", "BW")}


@obs_query(f"WITH {TC_VIEW} SELECT {KEYS_SQL}, {rounded_sql(ANGLES_SQL)} FROM tc")
def tc_angles(obs: DataFrame) -> DataFrame:
    return rounded(obs.withColumns(I.tasseled_cap(3)), KEYS, I.tasseled_cap_angles())


@obs_query(f"""WITH h AS (SELECT *, greatest(red, green, blue) AS top, NULLIF(greatest(red, green, blue) - least(red, green, blue), 0) AS span FROM obs),
k AS (SELECT *, CASE WHEN red = top THEN (CASE WHEN (green - blue) / span < 0 THEN (green - blue) / span + 6 ELSE (green - blue) / span END)
 WHEN green = top THEN (blue - red) / span + 2 WHEN blue = top THEN (red - green) / span + 4 END AS hue FROM h)
SELECT {KEYS_SQL}, round(hue, 6) AS hue, round(CASE WHEN hue <= 1.6::DOUBLE THEN nir - 1.03::DOUBLE * swir1 END, 6) AS bloom1, round(green / NULLIF(blue, 0), 6) AS bloom2 FROM k""")
def bloom_index(obs: DataFrame) -> DataFrame:
    c = I.bloom_indices()
    return rounded(obs, KEYS, {"hue": c["HOcalcHue"], "bloom1": c["bloom1"], "bloom2": c["bloom2"]})


def _masked(keep: str, names=("nir", "red")) -> str:
    return ", ".join(f"CASE WHEN {keep} THEN {b} END AS {b}" for b in names)


@obs_query(f"SELECT {KEYS_SQL}, {_masked('(qa & 8) = 0 AND (qa & 16) = 0')} FROM obs")
def qa_bitmask(obs: DataFrame) -> DataFrame:
    return B.mask(obs, M.fmask(F.col("qa"), "cloud") & M.fmask(F.col("qa"), "shadow"), ["nir", "red"]).select(*KEYS, "nir", "red")


@obs_query(f"SELECT {KEYS_SQL}, ((qa >> 3) & 3)::INTEGER AS bits FROM obs")
def qa_bits_range(obs: DataFrame) -> DataFrame:
    return obs.select(*KEYS, M.qa_bits(F.col("qa"), 3, 4).cast("int").alias("bits"))


@obs_query(f"SELECT {KEYS_SQL}, {_masked('((pk * 512) & 1024) = 0 AND ((pk * 512) & 2048) = 0')} FROM obs")
def s2_qa60_mask(obs: DataFrame) -> DataFrame:
    return B.mask(obs, M.qa60_clear(F.col("pk") * 512), ["nir", "red"]).select(*KEYS, "nir", "red")


def rescale_sql(x: str, a: float, b: float) -> str:
    return f"(({x}) - {a}::DOUBLE) / ({b - a!r})::DOUBLE"


VISIBLE, INFRARED = rescale_sql("red + green + blue", 0.2, 0.8), rescale_sql("nir + swir1 + swir2", 0.3, 0.8)


def _score(*parts: str) -> str:
    least = f"least(1::DOUBLE, {', '.join(parts)})"
    known = " AND ".join(f"({p}) IS NOT NULL" for p in parts)
    return f"CASE WHEN {known} THEN trunc(least(greatest({least} * 100::DOUBLE, 0::DOUBLE), 100::DOUBLE))::INTEGER END"


LANDSAT_SCORE = _score(rescale_sql("blue", 0.1, 0.3), VISIBLE, INFRARED, rescale_sql("coalesce(temp, 270)", 300, 290), rescale_sql(nd("green", "swir1"), 0.8, 0.6))


@obs_query(f"SELECT {KEYS_SQL}, {LANDSAT_SCORE} AS score FROM obs")
def cloud_score_landsat(obs: DataFrame) -> DataFrame:
    return obs.select(*KEYS, M.landsat_cloud_score().alias("score"))


@obs_query(f"WITH c AS (SELECT *, blue * 2 AS cb FROM obs) SELECT {KEYS_SQL}, {_score(f'greatest(0::DOUBLE, {rescale_sql("blue", 0.1, 0.5)}, {rescale_sql("cb", 0.1, 0.5)})', VISIBLE, INFRARED, rescale_sql(nd('green', 'swir1'), 0.8, 0.6))} AS score FROM c")
def cloud_score_s2(obs: DataFrame) -> DataFrame:
    return obs.withColumn("cb", F.col("blue") * 2).select(*KEYS, M.sentinel2_cloud_score().alias("score"))


@obs_query(f"WITH c AS (SELECT * REPLACE (CASE WHEN ln <> 3 THEN temp END AS temp) FROM obs) SELECT {KEYS_SQL}, CASE WHEN temp IS NULL THEN 100 ELSE {_score(VISIBLE, rescale_sql('nir + swir2 + swir2', 0.3, 0.8), rescale_sql(nd('green', 'swir2'), 0.8, 0.6))} END AS score FROM c")
def cloud_score_modis(obs: DataFrame) -> DataFrame:
    return obs.withColumn("temp", F.when(F.col("ln") != 3, F.col("temp"))).select(*KEYS, M.modis_cloud_score().alias("score"))


@obs_query(f"SELECT {KEYS_SQL}, {_masked('NOT (({0} > 0.4::DOUBLE AND nir > 0.11::DOUBLE) OR ({0} > 0.1::DOUBLE AND {0} < 0.4::DOUBLE))'.format('(' + nd('green', 'swir1') + ')'))} FROM obs")
def snow_mask(obs: DataFrame) -> DataFrame:
    return B.mask(obs, ~M.snow(), ["nir", "red"]).select(*KEYS, "nir", "red")


@obs_query(f"WITH {TC_VIEW} SELECT {KEYS_SQL}, (round(atan2(wetness, brightness) / {pi!r}::DOUBLE, 9) >= -0.05::DOUBLE AND round(atan2(greenness, brightness) / {pi!r}::DOUBLE, 9) <= 0.05::DOUBLE AND brightness < 0.3::DOUBLE) AS water FROM tc")
def water_mask(obs: DataFrame) -> DataFrame:
    rows = obs.withColumns(I.tasseled_cap(3)).withColumns({n: F.round(c, 9) for n, c in I.tasseled_cap_angles(("BG", "BW")).items()})
    return rows.select(*KEYS, M.water().alias("water"))


@obs_query(f"SELECT {KEYS_SQL}, {_masked('ln <> 2 AND pk % 7 <> 0', ('red', 'nir', 'swir1'))} FROM obs")
def all_band_mask(obs: DataFrame) -> DataFrame:
    holes = obs.withColumns({"red": F.when(F.col("ln") != 2, F.col("red")), "nir": F.when(F.col("pk") % 7 != 0, F.col("nir"))})
    return B.all_band_mask(holes, ["red", "nir", "swir1"]).select(*KEYS, "red", "nir", "swir1")


@obs_query(f"SELECT {KEYS_SQL}, round(yr + (doy - 1)::DOUBLE / (CASE WHEN (yr % 4 = 0 AND yr % 100 <> 0) OR yr % 400 = 0 THEN 366 ELSE 365 END)::DOUBLE, 9) AS year_dec, (yr * 1000 + doy)::INTEGER AS code, (CASE WHEN doy >= 300 THEN yr + 0 ELSE yr - 1 END)::INTEGER AS season FROM obs")
def date_bands(obs: DataFrame) -> DataFrame:
    t = F.col("t")
    return obs.select(*KEYS, F.round(D.decimal_year(t), 9).alias("year_dec"), D.year_day_code(t).cast("int").alias("code"), D.season_year(t, 300, 60).cast("int").alias("season"))


@obs_query(f"SELECT {KEYS_SQL}, CASE sensor WHEN 'A' THEN 5 WHEN 'N' THEN 7 WHEN 'R' THEN 8 END AS sensor_code FROM obs")
def sensor_band(obs: DataFrame) -> DataFrame:
    names = {"A": "LANDSAT_5", "N": "LANDSAT_7", "R": "LANDSAT_8"}
    return obs.select(*KEYS, B.remap("sensor", {k: SENSOR_CODES[v] for k, v in names.items()}).alias("sensor_code"))


@obs_query(f"SELECT {KEYS_SQL}, trunc(least(greatest(nir * 10000, -32768), 32767))::SMALLINT AS nir, coalesce(CASE WHEN ln <> 2 THEN trunc(red * 10000) END, -32768)::SMALLINT AS red FROM obs")
def export_packing(obs: DataFrame) -> DataFrame:
    from rastertime.sources.sinks import fill, pack

    holes = obs.withColumn("red", F.when(F.col("ln") != 2, F.col("red")))
    return fill(pack(holes, ["nir", "red"]), ["nir", "red"]).select(*KEYS, F.col("nir").cast("short").alias("nir"), F.col("red").cast("short").alias("red"))


@obs_query(f"""SELECT {KEYS_SQL}, 'old' AS part, red AS red, NULL::DOUBLE AS temp FROM obs WHERE yr < 1998 UNION ALL
SELECT {KEYS_SQL}, 'new' AS part, (red - (-0.0022)::DOUBLE) / 0.9825::DOUBLE AS red, temp FROM obs WHERE yr >= 1998""")
def union_sensors(obs: DataFrame) -> DataFrame:
    old = obs.where("yr < 1998").select(*KEYS, F.lit("old").alias("part"), "red")
    slope = F.col("red")
    new = obs.where("yr >= 1998").select(*KEYS, F.lit("new").alias("part"), ((slope - B.dbl(H.ROY_INTERCEPTS[2])) / B.dbl(H.ROY_SLOPES[2])).alias("red"), "temp")
    return merge(old, new)


@obs_query("SELECT sensor, orbit, count(*) AS n FROM obs GROUP BY ALL")
def sensor_histogram(obs: DataFrame) -> DataFrame:
    return obs.groupBy("sensor", "orbit").agg(F.count(F.lit(1)).alias("n"))


@obs_query("SELECT DISTINCT yr, sensor FROM obs")
def unique_values(obs: DataFrame) -> DataFrame:
    return obs.select("yr", "sensor").distinct()


@query("SELECT user_id, event_type, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events", obs=False)
def rolling_event_stats(spark, sf_dir):
    from pyspark.sql import Window

    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round(F.sum("value").over(over.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"), F.lag("event_type").over(over).alias("before"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL", obs=False)
def tumbling_window_events(spark, sf_dir):
    from rastertime.streaming.windows import tumbling

    out = tumbling(table(spark, sf_dir, "events"))
    day = F.date_format(F.col("start"), "yyyy-MM-dd")
    return out.select(day.alias("day"), "event_type", "n", *[F.round(c, 6).alias(c) for c in ("total", "low", "high")])


__all__ = ["BANDS"]
