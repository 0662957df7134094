"""Queries of what is read through the catalogue and of what exports leave behind, each written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions import dates as D
from rastertime.functions import harmonize as H
from rastertime.functions.bands import dbl
from rastertime.operators import joins as J
from rastertime.plans.history import ANNUAL, annual
from rastertime.plans.pipelines import interpolated
from rastertime.plans.registry import KEYS, KEYS_SQL, obs_query, query, rounded
from rastertime.sources import catalog as C
from rastertime.sources import exports as E
from rastertime.sources import sinks as W
from rastertime.sources.observations import grid, observations
from rastertime.sources.scratch import materialise, shared_dir

SIX = ["blue", "green", "red", "nir", "swir1", "swir2"]


def _stored(df: DataFrame) -> str:
    return materialise(df)._written


def _fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rt-{uuid.uuid4().hex}"


def _numbers(obs: DataFrame, names: list[str], factor: float) -> DataFrame:
    """Observations as a provider stores them: whole numbers under its names, and a band that nobody asks for."""
    own = dict(zip(C.NAMES, names))
    return obs.select(*KEYS, *[(F.floor(F.col(b) * factor) if b in SIX else F.col(b)).alias(own[b]) for b in C.NAMES], F.lit(1).alias("unused"))


@obs_query(f"""SELECT {KEYS_SQL}, qa, {", ".join(f"round(floor({b} * 20000) * 0.0000275::DOUBLE + (-0.2)::DOUBLE, 9) AS {b}" for b in SIX)}, round(temp * 0.00341802::DOUBLE + 149.0::DOUBLE, 6) AS temp FROM obs WHERE sensor = 'N'
UNION ALL SELECT {KEYS_SQL}, qa, {", ".join(f"round(floor({b} * 20000) * 0.0001::DOUBLE + 0.0::DOUBLE, 9) AS {b}" for b in SIX)}, round(temp * 0.1::DOUBLE + 0.0::DOUBLE, 6) AS temp FROM obs WHERE sensor = 'A'""")
def catalog_landsat(obs: DataFrame) -> DataFrame:
    """Two products under their providers' names, read, scaled by their collection's factors and merged."""
    spark, parts = obs.sparkSession, []
    for product, code in ((("C2", 8, "SR"), "N"), (("C1", 5, "SR"), "A")):
        path = _stored(_numbers(obs.where(F.col("sensor") == code), C.LANDSAT_BANDS[product], 20000))
        parts.append(H.apply_scale(C.landsat(path, product).read(spark, tuple(KEYS)), product[0]))
    return C.merge(*parts).select(*KEYS, "qa", *[F.round(b, 9).alias(b) for b in SIX], F.round("temp", 6).alias("temp"))


@obs_query(f"""SELECT {KEYS_SQL}, 'TOA' AS level, round(floor(nir * 9000) * 0.0001::DOUBLE, 9) AS nir, round(floor(red * 9000) * 0.0001::DOUBLE, 9) AS nir2, round(floor(swir1 * 9000) * 0.0001::DOUBLE, 9) AS swir1 FROM obs WHERE ln = 1
UNION ALL SELECT {KEYS_SQL}, 'SR', round(floor(nir * 9000) * 0.0001::DOUBLE, 9), round(floor(red * 9000) * 0.0001::DOUBLE, 9), round(floor(swir1 * 9000) * 0.0001::DOUBLE, 9) FROM obs WHERE ln = 2""")
def catalog_sentinel2(obs: DataFrame) -> DataFrame:
    """Both levels under their providers' names."""
    parts = []
    for level, ln in (("TOA", 1), ("SR", 2)):
        source = {"nir": "nir", "nir2": "red", "swir1": "swir1"}
        raw = obs.where(F.col("ln") == ln).select(*KEYS, *[F.floor(F.col(source.get(name, "blue")) * 9000).alias(band) for band, name in C.S2_BANDS[level].items()])
        parts.append(C.sentinel2(_stored(raw), level).read(obs.sparkSession, tuple(KEYS)).select(*KEYS, F.lit(level).alias("level"), "nir", "nir2", "swir1"))
    return rounded(C.merge(*parts), [*KEYS, "level"], ["nir", "nir2", "swir1"], 9)


@obs_query(f"""WITH o AS (SELECT * FROM obs QUALIFY count(*) OVER (PARTITION BY px, t, ok, ln, pk) = 1)
SELECT {KEYS_SQL}, CASE orbit WHEN 'F' THEN 'terra' ELSE 'aqua' END AS platform, round(floor(nir * 8000) * 0.0001::DOUBLE, 9) AS nir, round(floor(green * 8000) * 0.0001::DOUBLE, 9) AS green, round(temp * 50 * 0.02::DOUBLE, 6) AS temp FROM o WHERE pk % 4 > 0""")
def catalog_modis(obs: DataFrame) -> DataFrame:
    """Products of two resolutions and of temperature joined by cell and time, with their platform."""
    spark, on, parts = obs.sparkSession, ["px", "t", "ok", "ln", "pk"], []
    once = obs.join(obs.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n"), on, "left_semi")
    for platform, code in (("terra", "F"), ("aqua", "O")):
        own = once.where(F.col("orbit") == code)
        number = lambda c: F.floor(F.col(c) * 8000)
        raw = {
            "SR250": own.select(*on, "yr", "doy", number("red").alias("sur_refl_b01"), number("nir").alias("sur_refl_b02")),
            "SR500": own.select(*on, number("blue").alias("sur_refl_b03"), number("green").alias("sur_refl_b04"), number("swir1").alias("sur_refl_b06"), number("swir2").alias("sur_refl_b07")),
            "LST_daily": own.where("pk % 4 > 0").select(*on, (F.col("temp") * 50).alias("LST_Day_1km"), F.lit(1).alias("Emis_31"), F.lit(1).alias("Emis_32")),
        }
        read = {k: C.modis(_stored(df), k).read(spark, tuple([*on, "yr", "doy"] if k == "SR250" else on)) for k, df in raw.items()}
        parts.append(J.by_time(read, on).withColumn("platform", F.lit(platform)))
    out = C.merge(*parts)
    return out.select(*KEYS, "platform", F.round("nir", 9).alias("nir"), F.round("green", 9).alias("green"), F.round("temp", 6).alias("temp"))


@obs_query(f"""SELECT {KEYS_SQL}, round(blue, 9) AS prcp, temp + 5 AS tmax, temp - 5 AS tmin FROM obs WHERE t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1997-01-01' AND doy BETWEEN 60 AND 200""")
def catalog_climate(obs: DataFrame) -> DataFrame:
    """A daily climate product of a year's season."""
    made = {"prcp": F.col("blue"), "tmax": F.col("temp") + 5, "tmin": F.col("temp") - 5}
    raw = obs.select(*KEYS, "t", *[made.get(b, dbl(0)).alias(b) for b in C.CLIMATE_BANDS["DAYMET_V4"]], F.lit("x").alias("unused"))
    df = C.climate(_stored(raw)).read(obs.sparkSession, (*KEYS, "t"))
    df = df.where(D.in_dates(F.col("t"), "1996-01-01", "1997-01-01") & D.in_days(F.dayofyear("t"), 60, 200))
    return df.select(*KEYS, F.round("prcp", 9).alias("prcp"), "tmax", "tmin")


@obs_query(f"SELECT {KEYS_SQL}, yr % 100 * 1000 + doy AS code, NULL::DOUBLE AS cirrus, round(nir, 9) AS nir FROM obs WHERE sensor = 'A'")
def missing_bands_filled(obs: DataFrame) -> DataFrame:
    """An empty collection of another sensor, and a band that none has: the bands of both, NULL where there is nothing."""
    a = obs.where("sensor = 'A'").select(*KEYS, "t", "nir")
    none = obs.where("sensor = 'Z'").select(*KEYS, "t", "nir").withColumn("cirrus", dbl(1))
    out = C.merge(C.missing_bands(a, ["nir", "cirrus"]), none)
    return out.select(*KEYS, D.year_day_code(F.col("t"), full=False).alias("code"), "cirrus", F.round("nir", 9).alias("nir"))


@obs_query(f"""WITH {ANNUAL}, w AS (SELECT px, yr, epoch(make_date(yr, 6, 1))::BIGINT AS ts, CASE WHEN yr % 3 > 0 THEN nir END AS nir FROM ann),
b AS (SELECT px, yr, ts, nir, last_value(CASE WHEN nir IS NOT NULL THEN ts END IGNORE NULLS) OVER bk AS b_at, last_value(nir IGNORE NULLS) OVER bk AS b_v, first_value(CASE WHEN nir IS NOT NULL THEN ts END IGNORE NULLS) OVER ah AS a_at, first_value(nir IGNORE NULLS) OVER ah AS a_v FROM w
 WINDOW bk AS (PARTITION BY px ORDER BY ts RANGE BETWEEN {732 * 86400} PRECEDING AND CURRENT ROW), ah AS (PARTITION BY px ORDER BY ts RANGE BETWEEN CURRENT ROW AND {732 * 86400} FOLLOWING))
SELECT px, yr, round(coalesce(nir, b_v + (a_v - b_v) * coalesce((ts - b_at)::DOUBLE / NULLIF(a_at - b_at, 0)::DOUBLE, 0), b_v, a_v), 9) AS nir FROM b""")
def annual_interpolated(obs: DataFrame) -> DataFrame:
    """Yearly values of every third year masked, and filled from up to two years away."""
    rows = annual(obs).select("px", "yr", D.stamp(F.col("yr")).alias("t"), F.when(F.col("yr") % 3 > 0, F.col("nir")).alias("nir"))
    return rounded(interpolated(rows, ["nir"], 2, ["px"]), ["px", "yr"], ["nir"], 9)


@obs_query(f"WITH {ANNUAL} SELECT px, yr, coalesce(trunc(round(v, 9) * 10000), -32768)::SMALLINT AS v, coalesce(trunc(round(nir, 9) * 10000), -32768)::SMALLINT AS nir FROM ann WHERE yr BETWEEN 1995 AND 2001")
def export_yearly(obs: DataFrame) -> DataFrame:
    """A yearly collection packed and written under its full name, a folder a year, then copied and read from the copy."""
    spark = obs.sparkSession
    rows = annual(obs).select("px", "yr", F.col("yr").alias("year"), F.round("v", 9).alias("v"), F.round("nir", 9).alias("nir"))
    path = W.export_collection(rows, _fresh(spark), "annual medians", (1995, 2001), (152, 273), ["v", "nir"])
    copy = _fresh(spark)
    W.copy(spark, path, copy)
    return spark.read.parquet(copy).select("px", F.col("yr").cast("long").alias("yr"), "v", "nir")


@query("SELECT s_suppkey AS px, s_suppkey // 10 AS row, s_suppkey % 10 AS col, s_nationkey AS zone, round(s_acctbal, 2) AS z FROM supplier", obs=False)
def export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table as CSV, and as JSON of what was read from that."""
    rows = grid(spark, sf_dir).select("px", "row", "col", "zone", F.round("z", 2).alias("z"))
    a = W.export(rows, _fresh(spark), (), "csv")
    b = W.export(spark.read.schema(rows.schema).csv(a), _fresh(spark), ("zone",), "json")
    return spark.read.schema(rows.schema).json(b).select(*rows.columns)


@obs_query(f"""WITH {ANNUAL} SELECT px, yr, 'tables-of-years_SR_median_' || (yr - 1) || '_' || (yr + 1) || '_152_273' AS "exportName", round(trunc(round(nir, 9) * 10000) / 10000, 9) AS nir FROM ann WHERE yr BETWEEN 1996 AND 2000""")
def export_composites(obs: DataFrame) -> DataFrame:
    """Composites exported with the options that made them, and read back by their manifest."""
    spark = obs.sparkSession
    rows = annual(obs).select("px", F.col("yr").alias("year"), F.round("nir", 9).alias("nir"))
    made = E.properties(spark, "tables of years", {"method": "median"}, (1995, 2001), (152, 273), 1, "median")
    out = E.read_composites(spark, E.export_composites(rows, _fresh(spark), ["nir"], made))
    return out.select("px", F.col("year").cast("long").alias("yr"), "exportName", F.round("nir", 9).alias("nir"))


@query("""SELECT '<Placemark><name>' || s_suppkey || '</name><ExtendedData><Data name="nation"><value>' || replace(n_name, '&', '&amp;') || '</value></Data></ExtendedData><Point><coordinates>' || (s_suppkey % 10) || ',' || (s_suppkey // 10) || '</coordinates></Point></Placemark>' AS mark
FROM supplier JOIN nation ON n_nationkey = s_nationkey""", obs=False)
def export_placemarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as KML, read back line by line."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("nation"))
    rows = grid(spark, sf_dir).join(names, "zone").select("px", "col", "row", "nation")
    path = E.export_kml(rows, _fresh(spark), "col", "row", "px", ["nation"])
    return spark.read.text(path).where(F.col("value").startswith("<Placemark>")).select(F.col("value").alias("mark"))
