"""Queries of the primitives that recipes build on: reducers, arrays, maps, dates, names, sets, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.operators import focal as L
from rastertime.plans.history import ANNUAL, annual
from rastertime.plans.registry import KEYS, KEYS_SQL, obs_query, query
from rastertime.sources.observations import grid, table


@obs_query("""SELECT px, yr, round(min(nir), 9) AS lo, round(max(nir), 9) AS hi, round(sum(nir), 6) AS total, round(quantile_cont(nir, 0.1), 9) AS p10, round(quantile_cont(nir, 0.9), 9) AS p90, round(var_pop(nir), 9) AS var,
mode(ln ORDER BY ln) AS common, arg_min(ln, (t, ok, ln, pk)) FILTER (WHERE ln <> 2) AS first_valid, arg_max(ln, (t, ok, ln, pk)) FILTER (WHERE ln <> 2) AS last_valid FROM obs GROUP BY px, yr""")
def reducers(obs: DataFrame) -> DataFrame:
    order = F.struct("t", "ok", "ln", "pk")
    valid = F.when(F.col("ln") != 2, order)
    floats = {"lo": F.min("nir"), "hi": F.max("nir"), "p10": F.percentile("nir", 0.1), "p90": F.percentile("nir", 0.9), "var": F.var_pop("nir")}
    return obs.groupBy("px", "yr").agg(
        *[F.round(c, 9).alias(n) for n, c in floats.items()], F.round(F.sum("nir"), 6).alias("total"), F.mode("ln", deterministic=True).alias("common"), F.min_by("ln", valid).alias("first_valid"), F.max_by("ln", valid).alias("last_valid")
    )


@obs_query(f"""WITH {ANNUAL}, a AS (SELECT px, list(yr ORDER BY yr) AS ys, list(round(v, 9) ORDER BY yr) AS vs FROM ann GROUP BY px)
SELECT px, ys[2:4] AS middle, list_sort(vs) AS sorted, list_filter(vs, lambda x: x > 0.28) AS kept, vs[len(vs)] AS last, len(vs)::INTEGER AS n, list_concat(ys, [0]) AS joined, ys[list_position(vs, list_max(vs))] AS best_year FROM a""")
def array_primitives(obs: DataFrame) -> DataFrame:
    pairs = annual(obs).groupBy("px").agg(F.sort_array(F.collect_list(F.struct("yr", F.round("v", 9).alias("v")))).alias("p"))
    a = pairs.select("px", F.col("p.yr").alias("ys"), F.col("p.v").alias("vs"))
    best = F.get("ys", (F.array_position("vs", F.array_max("vs")) - 1).cast("int"))
    return a.select("px", F.slice("ys", 2, 3).alias("middle"), F.array_sort("vs").alias("sorted"), F.filter("vs", lambda x: x > 0.28).alias("kept"), F.element_at("vs", -1).alias("last"), F.size("vs").alias("n"), F.concat("ys", F.array(F.lit(0))).alias("joined"), best.alias("best_year"))


@obs_query(f"WITH {ANNUAL} SELECT px, yr, round(sum(round(v, 6)) OVER (PARTITION BY px ORDER BY yr), 6) AS total FROM ann")
def array_running_sum(obs: DataFrame) -> DataFrame:
    pairs = annual(obs).groupBy("px").agg(F.sort_array(F.collect_list(F.struct("yr", F.round("v", 6).alias("v")))).alias("p"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    sums = F.aggregate("p", start, lambda a, x: F.struct((a["s"] + x["v"]).alias("s"), F.concat(a["out"], F.array(a["s"] + x["v"])).alias("out")), lambda a: a["out"])
    rows = pairs.select("px", F.explode(F.arrays_zip(F.col("p.yr").alias("yr"), sums.alias("total"))).alias("z"))
    return rows.select("px", "z.yr", F.round("z.total", 6).alias("total"))


@obs_query("SELECT px, max(CASE WHEN sensor = 'A' THEN n END) AS a, max(CASE WHEN sensor = 'Z' THEN n END) AS z, count(*)::INTEGER AS kinds, string_agg(sensor, ' ' ORDER BY sensor) AS names FROM (SELECT px, sensor, count(*) AS n FROM obs GROUP BY ALL) GROUP BY px")
def map_properties(obs: DataFrame) -> DataFrame:
    counts = obs.groupBy("px", "sensor").agg(F.count(F.lit(1)).alias("n"))
    props = counts.groupBy("px").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sensor", "n")))).alias("m"))
    return props.select("px", F.try_element_at("m", F.lit("A")).alias("a"), F.try_element_at("m", F.lit("Z")).alias("z"), F.size("m").alias("kinds"), F.array_join(F.map_keys("m"), " ").alias("names"))


@obs_query(f"SELECT {KEYS_SQL}, strftime(t, '%Y-%m-%d') AS day, (yr || lpad(doy::VARCHAR, greatest(2, len(doy::VARCHAR))::INTEGER, '0')) AS code, strftime(t + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, epoch_ms(t) AS millis, date_diff('day', make_date(yr, 6, 1), t::DATE)::INTEGER AS since FROM obs")
def date_formats(obs: DataFrame) -> DataFrame:
    doy = F.col("doy").cast("string")
    code = F.concat(F.col("yr").cast("string"), F.lpad(doy, F.greatest(F.lit(2), F.length(doy)), F.lit("0")))
    stamp = F.col("t").cast("timestamp")
    return obs.select(*KEYS, F.date_format("t", "yyyy-MM-dd").alias("day"), code.alias("code"), F.date_format(F.add_months("t", 1), "yyyy-MM-dd").alias("later"), F.unix_millis(stamp).alias("millis"), F.datediff(F.to_date("t"), F.make_date("yr", F.lit(6), F.lit(1))).alias("since"))


@query("SELECT p_partkey, regexp_replace(trim(p_name), '\\s+', '-', 'g') || '_' || upper(substr(p_brand, 1, 5)) || '_1995_2001' AS name FROM part", obs=False)
def string_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.concat(F.regexp_replace(F.trim("p_name"), r"\s+", "-"), F.lit("_"), F.upper(F.substring("p_brand", 1, 5)), F.lit("_1995_2001")).alias("name"))


@obs_query("""SELECT 'merge' AS op, px, yr FROM (SELECT px, yr FROM obs WHERE ln = 1 UNION ALL SELECT px, yr FROM obs WHERE ln = 7) UNION ALL SELECT 'less', px, yr FROM (SELECT px, yr FROM obs WHERE sensor = 'A' EXCEPT SELECT px, yr FROM obs WHERE sensor = 'N')
UNION ALL SELECT 'both', px, yr FROM (SELECT px, yr FROM obs WHERE ln = 6 INTERSECT SELECT px, yr FROM obs WHERE ln = 7)""")
def set_operations(obs: DataFrame) -> DataFrame:
    k = lambda cond: obs.where(cond).select("px", "yr")
    parts = {"merge": k("ln = 1").unionByName(k("ln = 7")), "less": k("sensor = 'A'").subtract(k("sensor = 'N'")), "both": k("ln = 6").intersect(k("ln = 7"))}
    out = [df.select(F.lit(op).alias("op"), "px", "yr") for op, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@obs_query("SELECT px, ok, ln, pk, yr, doy, nir FROM obs ORDER BY nir DESC, px, ok, ln, pk, t LIMIT 50")
def largest_values(obs: DataFrame) -> DataFrame:
    return obs.orderBy(F.col("nir").desc(), "px", "ok", "ln", "pk", "t").limit(50).select("px", "ok", "ln", "pk", "yr", "doy", "nir")


@query(f"""SELECT a.row, a.col, {', '.join(f"max(CASE WHEN b.row - a.row = {r} AND b.col - a.col = {c} THEN b.z END) AS z_{r + 1}_{c + 1}" for r in (-1, 0, 1) for c in (-1, 0, 1))} FROM grid a JOIN grid b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col""")
def neighbourhood_to_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {f"z_{r + 1}_{c + 1}": F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("z"))) for r, c in L.square(1)}
    return L.focal(grid(spark, sf_dir).select("row", "col", "z"), at, L.square(1))


@obs_query("SELECT count(*) AS n, round(avg(nir), 9) AS mean, round(stddev_pop(nir), 9) AS sd, round(regr_slope(nir, red), 9) AS slope, round(covar_pop(nir, swir1), 9) AS cov FROM obs WHERE row BETWEEN 2 AND 6")
def region_statistics(obs: DataFrame) -> DataFrame:
    c = {"mean": F.avg("nir"), "sd": F.stddev_pop("nir"), "slope": F.regr_slope("nir", "red"), "cov": F.covar_pop("nir", "swir1")}
    return obs.where(F.col("row").between(2, 6)).agg(F.count(F.lit(1)).alias("n"), *[F.round(e, 9).alias(n) for n, e in c.items()])


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""", obs=False)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("_ts", F.col("ts").cast("timestamp"))
    out = events.groupBy(F.session_window("_ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("user_id", F.unix_micros("w.start").alias("began"), "n", "total")


@query("SELECT event_id, (props->>'k')::INTEGER AS k FROM events WHERE (props->>'k') IS NOT NULL", obs=False)
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k IS NOT NULL")
