"""Queries of single helpers: ranking choices, stacks read back, dates, texts, arrays, neighbourhood statistics, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.functions import dates as D
from rastertime.functions import harmonize as H
from rastertime.functions import segments as S
from rastertime.operators import focal as L
from rastertime.operators.reproject import Grid, reproject
from rastertime.plans.history import ANNUAL, SEGS, VERTS, annual, verts
from rastertime.plans.registry import KEYS, KEYS_SQL, obs_query, query, rounded
from rastertime.plans.space import _near, grid_query
from rastertime.sources.catalog import describe, metadata
from rastertime.sources.observations import table
from rastertime.streaming.windows import hopping

LIMITS = {"loss": (-0.02, -0.01), "gain": (0.02, 0.01)}
RANKED = " UNION ALL ".join(
    f"SELECT px, '{kind}' AS kind, '{choice}' AS choice, yr, dur, mag, row_number() OVER (PARTITION BY px ORDER BY {field} {'DESC' if down else 'ASC'}, yr) AS k FROM sg "
    f"WHERE mag {op} {LIMITS[kind][0]} OR slope {op} {LIMITS[kind][1]}"
    for kind, op in (("loss", "<="), ("gain", ">="))
    for choice, (field, down) in S.CHOICES[kind].items()
)


@obs_query(f"WITH {SEGS}, r AS ({RANKED}) SELECT px, kind, choice, yr, dur::INTEGER AS dur, round(mag, 6) AS mag FROM r WHERE k = 1")
def loss_gain_choices(obs: DataFrame) -> DataFrame:
    """The first loss and gain of every pixel by each of the eight choices."""
    best = [
        F.struct(F.lit(kind).alias("kind"), F.lit(choice).alias("choice"), F.get(S.loss_gain(F.col("verts"), kind, choice, *LIMITS[kind]), F.lit(0)).alias("s"))
        for kind in S.CHOICES
        for choice in S.CHOICES[kind]
    ]
    rows = verts(obs).select("px", F.explode(F.array(*best)).alias("b")).where("b.s IS NOT NULL")
    return rows.select("px", "b.kind", "b.choice", "b.s.yr", "b.s.dur", F.round("b.s.mag", 6).alias("mag"))


@obs_query(f"WITH {VERTS} SELECT px, count(*)::INTEGER AS n, min(yr) AS first, max(yr) AS last, round(sum(fit), 6) AS total FROM vx WHERE k <= 5 GROUP BY px")
def stack_read_back(obs: DataFrame) -> DataFrame:
    """Padded columns of five vertices back to arrays."""
    wide = verts(obs).select("px", *[c.alias(n) for n, c in S.padded(F.col("verts"), 5).items()])
    v = wide.select("px", S.from_padded(5).alias("v"))
    years, fits = F.transform("v", lambda p: p["yr"]), F.transform("v", lambda p: p["fit"])
    total = F.aggregate(fits, B.dbl(0), lambda a, x: a + x)
    return v.select("px", F.size("v").alias("n"), F.array_min(years).alias("first"), F.array_max(years).alias("last"), F.round(total, 6).alias("total"))


@obs_query(f"""SELECT {KEYS_SQL}, strftime(t + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, strftime(t - INTERVAL 1 YEAR, '%Y-%m-%d') AS before, strftime(t + INTERVAL 16 DAY, '%Y-%m-%d') AS pass,
lpad((yr % 100)::VARCHAR, 2, '0') || lpad(doy::VARCHAR, 3, '0') AS code, strftime(make_date(yr, 1, 1) + (doy - 1)::INTEGER, '%Y-%m-%d') AS parsed FROM obs""")
def shifted_dates(obs: DataFrame) -> DataFrame:
    """Dates moved by months, years and days, packed as two digits of the year and three of the day, and parsed again."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    t = F.col("t")
    code = F.date_format("t", "yyDDD")
    parsed = F.to_date(F.date_format("t", "yyyy-D"), "yyyy-D")
    return obs.select(*KEYS, day(D.offset_date(t, 1, "month")).alias("later"), day(D.offset_date(t, -1, "year")).alias("before"), day(D.offset_date(t, 16, "day")).alias("pass"), code.alias("code"), day(parsed).alias("parsed"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS head, len(string_split(p_name, ' '))::INTEGER AS words, CASE WHEN p_brand < p_type THEN -1 WHEN p_brand > p_type THEN 1 ELSE 0 END AS compared FROM part""", obs=False)
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    compared = F.when(F.col("p_brand") < F.col("p_type"), -1).when(F.col("p_brand") > F.col("p_type"), 1).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(words, F.lit(0)).alias("head"), F.size(words).alias("words"), compared.alias("compared"))


@obs_query(f"WITH {ANNUAL} SELECT px, round(quantile_cont(v, 0.1), 9) AS low, round(quantile_cont(v, 0.5), 9) AS middle, round(quantile_cont(v, 0.9), 9) AS high FROM ann GROUP BY px")
def array_percentiles(obs: DataFrame) -> DataFrame:
    rows = annual(obs).groupBy("px").agg(F.collect_list("v").alias("a"))
    return rounded(rows, ["px"], {n: B.array_percentile(F.col("a"), p) for n, p in (("low", 10), ("middle", 50), ("high", 90))}, 9)


@obs_query(f"SELECT {KEYS_SQL}, round(NULLIF(coalesce(CASE WHEN ln <> 2 THEN green END, CASE WHEN pk % 3 > 0 THEN blue END), 0), 9) AS green FROM obs")
def masked_filled(obs: DataFrame) -> DataFrame:
    """A band's gaps from another band, then without the no-data value."""
    x, new = F.when(F.col("ln") != 2, F.col("green")), F.when(F.col("pk") % 3 > 0, F.col("blue"))
    return rounded(obs, KEYS, {"green": B.replace_mask(x, new)}, 9)


@obs_query(f"""SELECT {KEYS_SQL}, CASE WHEN doy % 60 > 0 THEN round((pk * 0.00002::DOUBLE - 0.1::DOUBLE) / sin(radians(doy % 60)), 9) END AS refl,
CASE WHEN pk % 16 > 0 THEN round(1321.0789::DOUBLE / ln(774.8853::DOUBLE / (pk % 16) + 1), 6) END AS temp FROM obs""")
def toa_calibration(obs: DataFrame) -> DataFrame:
    """Whole numbers of a sensor to reflectance by the scene's gain, bias and sun, and to brightness temperature."""
    refl = H.toa_reflectance(F.col("pk").cast("double"), B.dbl(0.00002), B.dbl(-0.1), (F.col("doy") % 60).cast("double"))
    temp = H.brightness_temperature((F.col("pk") % 16).cast("double"), "L8")
    return obs.select(*KEYS, F.round(refl, 9).alias("refl"), F.round(temp, 6).alias("temp"))


@obs_query("""SELECT count(*) AS size, strftime(min(t), '%Y-%m-%d') AS first, strftime(max(t), '%Y-%m-%d') AS last, 'px,t,nir,red' AS bands FROM obs""")
def collection_facts(obs: DataFrame) -> DataFrame:
    facts = describe(obs.select("px", "t", "nir", "red"))
    return facts.select("size", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")], "bands")


@grid_query(f"WITH {_near(2.5)} SELECT row, col, count(z) AS n, round(avg(z), 4) AS mean, round(var_pop(z), 2) AS variance, round(stddev_pop(z), 4) AS sd, round(median(z), 4) AS median FROM near GROUP BY row, col")
def neighbourhood_statistics(g: DataFrame) -> DataFrame:
    exprs = {"n": F.count("z"), "mean": F.round(F.avg("z"), 4), "variance": F.round(F.var_pop("z"), 2), "sd": F.round(F.stddev_pop("z"), 4), "median": F.round(F.median("z"), 4)}
    return L.focal(g.select("row", "col", "z"), exprs, L.circle(2.5))


@grid_query("""WITH d AS (SELECT x AS dr, y AS dc FROM range(-1, 2) p(x), range(-1, 2) q(y)), n AS (SELECT a.row, a.col, b.zone, count(*) AS n FROM grid a, d JOIN grid b ON b.row = a.row + d.dr AND b.col = a.col + d.dc GROUP BY ALL)
SELECT row, col, zone FROM n QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, zone) = 1""")
def focal_mode(g: DataFrame) -> DataFrame:
    """The commonest zone around each cell, of equally common ones the least."""
    return L.focal_mode(g.select("row", "col", "zone"), "zone", 1.5)


@grid_query("""WITH d AS (SELECT x AS dr, y AS dc FROM range(-1, 2) p(x), range(-1, 2) q(y)),
s AS (SELECT a.row, a.col, count(*) AS n, sum(b.z * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 80000::DOUBLE AS gx, sum(b.z * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 80000::DOUBLE AS gy FROM grid a, d JOIN grid b ON b.row = a.row + d.dr AND b.col = a.col + d.dc GROUP BY ALL),
t AS (SELECT row, col, n, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(-gx, gy) AS aspect FROM s)
SELECT row, col, CASE WHEN n = 9 THEN round(cos(radians(35)) * cos(slope) + sin(radians(35)) * sin(slope) * cos(radians(140) - aspect), 9) END AS "IC" FROM t""")
def illumination_condition(g: DataFrame) -> DataFrame:
    """Sun 35 degrees from the zenith, in the south-east."""
    out = L.terrain(g.select("row", "col", "z"), "z", 10000.0).withColumn("IC", L.illumination(B.dbl(35), B.dbl(140)))
    return rounded(out, ["row", "col"], ["IC"], 9)


@query("""SELECT strftime(date_trunc('day', ts) - to_days(i::INTEGER), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(0, 3) r(i) GROUP BY ALL""", obs=False)
def hopping_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days, one a day."""
    out = hopping(table(spark, sf_dir, "events"), "3 days", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


@obs_query(f"""SELECT {KEYS_SQL}, sensor, round(nir, 9) AS nir FROM obs WHERE sensor IN ('A', 'N') AND contains(orbit, 'F') AND NOT starts_with(sensor, 'N') AND ln <= 4 AND pk >= 20""")
def metadata_filters(obs: DataFrame) -> DataFrame:
    """Scenes by filters of their properties."""
    for name, operator, value in (("sensor", "in_list", ["A", "N"]), ("orbit", "contains", "F"), ("sensor", "not_starts_with", "N"), ("ln", "not_greater_than", 4), ("pk", "not_less_than", 20)):
        obs = obs.where(metadata(name, operator, value))
    return rounded(obs, [*KEYS, "sensor"], ["nir"], 9)


@obs_query(f"""SELECT {KEYS_SQL}, CASE WHEN sensor = 'R' THEN 'R' ELSE sensor || '-N' END AS named, round(CASE WHEN nir > red THEN nir - red ELSE 0 END, 9) AS more FROM obs""")
def band_expression_text(obs: DataFrame) -> DataFrame:
    """Expressions whose texts look like band names."""
    names = {"N": "nir", "R": "red", "S": "sensor"}
    named = B.expression("CASE WHEN S = 'R' THEN 'R' ELSE concat(S, '-N') END", names)
    return obs.select(*KEYS, named.alias("named"), F.round(B.expression("if(N > R, N - R, 0D)", names), 9).alias("more"))


#: A grid turned by a right angle and half as fine, and one moved by fractions of a cell.
TURNED, FINE = Grid(3.0, -1.0, 0.0, 2.0, -2.0, 0.0), Grid(0.25, -0.375, 0.5, 0.0, 0.0, 0.5)


@grid_query("""WITH s AS (SELECT col::DOUBLE AS x, row::DOUBLE AS y, z FROM grid), t AS (SELECT (x - 3) / 2 AS fr, -(y + 1) / 2 AS fc, z FROM s)
SELECT floor(fr + 0.5::DOUBLE)::BIGINT AS row, floor(fc + 0.5::DOUBLE)::BIGINT AS col, round(avg(z), 6) AS z FROM t GROUP BY ALL""")
def reproject_mean(g: DataFrame) -> DataFrame:
    """Means of the surface on a turned and coarser grid."""
    return rounded(reproject(g, ["z"], Grid(), TURNED, "mean"), ["row", "col"], ["z"])


@grid_query("""WITH b AS (SELECT min(row) * 2 - 4 AS r0, max(row) * 2 + 6 AS r1, min(col) * 2 - 4 AS c0, max(col) * 2 + 6 AS c1 FROM grid), t AS (SELECT r AS row, c AS col FROM b, unnest(range(r0, r1)) p(r), unnest(range(c0, c1)) q(c))
SELECT t.row, t.col, grid.z FROM t JOIN grid ON grid.row = floor(-0.375::DOUBLE + t.row * 0.5::DOUBLE + 0.5::DOUBLE) AND grid.col = floor(0.25::DOUBLE + t.col * 0.5::DOUBLE + 0.5::DOUBLE)""")
def reproject_nearest(g: DataFrame) -> DataFrame:
    """The surface on a finer grid, moved by fractions of a cell."""
    return reproject(g.select("row", "col", "z"), ["z"], Grid(), FINE)
