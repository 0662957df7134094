"""Queries on the grid: neighbourhoods, terrain, patches, zones, normalisation."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.operators import classify as C
from rastertime.operators import focal as L
from rastertime.operators import lines
from rastertime.operators import normalize as N
from rastertime.operators import patches
from rastertime.plans.registry import KEYS, obs_query, query, rounded, rounded_sql
from rastertime.sources.observations import grid, table
from rastertime.sources.sinks import pyramid

DISC = "d.dr * d.dr + d.dc * d.dc"


def _near(radius: float) -> str:
    r = int(radius)
    return f"near AS (SELECT a.row, a.col, b.z, d.dr, d.dc FROM grid a, (SELECT x AS dr, y AS dc FROM range({-r}, {r + 1}) p(x), range({-r}, {r + 1}) q(y) WHERE x * x + y * y <= {radius * radius}) d JOIN grid b ON b.row = a.row + d.dr AND b.col = a.col + d.dc)"


def grid_query(sql: str):
    """Registers a function of the supplier grid."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(grid(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        query(sql)(run)
        return fn

    return keep


@grid_query(f"WITH {_near(1.5)} SELECT row, col, max(z) AS z FROM near GROUP BY row, col")
def focal_max(g: DataFrame) -> DataFrame:
    return L.focal_max(g, "z", 1.5)


@grid_query(f"WITH {_near(2.5)} SELECT row, col, round(avg(z), 6) AS z FROM near GROUP BY row, col")
def focal_mean(g: DataFrame) -> DataFrame:
    return rounded(L.focal_mean(g, "z", 2.5), ["row", "col"], ["z"])


@grid_query("""WITH c AS (SELECT row, col, (z > 0)::INTEGER AS z FROM grid), d AS (SELECT x AS dr, y AS dc, x * x + y * y AS r2 FROM range(-3, 4) p(x), range(-3, 4) q(y)),
m AS (SELECT a.row, a.col, max(b.z) AS z FROM c a, d JOIN c b ON b.row = a.row + d.dr AND b.col = a.col + d.dc WHERE r2 <= 2.25 GROUP BY ALL)
SELECT a.row, a.col, min(b.z) AS z FROM m a, d JOIN m b ON b.row = a.row + d.dr AND b.col = a.col + d.dc WHERE r2 <= 6.25 GROUP BY ALL""")
def dilate_erode(g: DataFrame) -> DataFrame:
    return L.contract_dilate(g.select("row", "col", (F.col("z") > 0).cast("int").alias("z")), "z", 1.5, 2.5)


@grid_query("""WITH d AS (SELECT x AS dr, y AS dc FROM range(-4, 5) p(x), range(-4, 5) q(y) WHERE (x + y) % 2 = 0)
SELECT a.row, a.col, count(*) FILTER (WHERE b.z > 0) AS n FROM grid a, d JOIN grid b ON b.row = a.row + d.dr AND b.col = a.col + d.dc GROUP BY ALL""")
def kernel_sum(g: DataFrame) -> DataFrame:
    out = L.kernel_sum(g.select("row", "col", (F.col("z") > 0).cast("double").alias("v")), "v", L.striped(4), "n")
    return out.select("row", "col", F.col("n").cast("long").alias("n"))


@grid_query("""WITH d AS (SELECT x AS dr, y AS dc FROM range(-4, 5) p(x), range(-4, 5) q(y) WHERE (x + y) % 2 = 0),
k AS (SELECT a.row, a.col, count(*) FILTER (WHERE b.z > 0) AS n FROM grid a, d JOIN grid b ON b.row = a.row + d.dr AND b.col = a.col + d.dc GROUP BY ALL)
SELECT grid.row, grid.col, CASE WHEN n >= 15 THEN z END AS z FROM grid JOIN k ON k.row = grid.row AND k.col = grid.col""")
def defringe(g: DataFrame) -> DataFrame:
    rows = g.select("row", "col", "z", (F.col("z") > 0).alias("valid"))
    return L.defringe(rows, ["z"], "valid", 15, L.striped(4)).select("row", "col", "z")


@grid_query(f"""WITH d AS (SELECT x AS dr, y AS dc FROM range(-1, 2) p(x), range(-1, 2) q(y)),
s AS (SELECT a.row, a.col, count(*) AS n, sum(b.z * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 800::DOUBLE AS gx, sum(b.z * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 800::DOUBLE AS gy FROM grid a, d JOIN grid b ON b.row = a.row + d.dr AND b.col = a.col + d.dc GROUP BY ALL),
t AS (SELECT row, col, n, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, gy)) AS aspect FROM s)
SELECT row, col, round(CASE WHEN n = 9 THEN slope END, 6) AS slope, round(CASE WHEN n = 9 THEN CASE WHEN aspect < 0 THEN aspect + 360 ELSE aspect END END, 6) AS aspect FROM t""")
def terrain_slope(g: DataFrame) -> DataFrame:
    return rounded(L.terrain(g.select("row", "col", "z"), "z", 100.0), ["row", "col"], ["slope", "aspect"])


@grid_query("SELECT (row // 4)::BIGINT AS row, (col // 4)::BIGINT AS col, round(avg(z), 6) AS z, count(z) AS n FROM grid GROUP BY 1, 2")
def reduce_resolution(g: DataFrame) -> DataFrame:
    return rounded(L.reduce_resolution(g, ["z"], 4), ["row", "col", "n"], ["z"])


@grid_query("SELECT (row // 2)::BIGINT AS row, (col // 2)::BIGINT AS col, round(avg(z), 6) AS z, mode(zone ORDER BY zone) AS zone FROM (SELECT row, col, z, min(zone // 5)::INTEGER AS zone FROM grid GROUP BY ALL) GROUP BY 1, 2")
def export_pyramid(g: DataFrame) -> DataFrame:
    rows = g.withColumn("zone", F.expr("zone div 5").cast("int"))
    return rounded(pyramid(rows, {"z": "mean", "zone": "mode"}, 1), ["row", "col", "zone"], ["z"])


def _shifts() -> list[tuple[int, int]]:
    from math import cos, radians, sin, tan

    az, reach = radians(135.0) + pi, tan(radians(40.0))
    return sorted({(round(h * reach * cos(az) / 30), round(h * reach * sin(az) / 30)) for h in (30, 60, 90)})


@grid_query(f"""WITH cl AS (SELECT row, col FROM grid WHERE z > 6000), dk AS (SELECT row, col, (z < 3000)::INTEGER AS dark FROM grid), sh(dr, dc) AS (VALUES {', '.join(str(s) for s in _shifts())}),
th AS (SELECT DISTINCT cl.row + dr AS row, cl.col + dc AS col FROM cl, sh), s AS (SELECT dk.row, dk.col, CASE WHEN th.row IS NULL THEN 0 ELSE dark END AS shadow FROM dk LEFT JOIN th ON th.row = dk.row AND th.col = dk.col),
d AS (SELECT x AS dr, y AS dc, x * x + y * y AS r2 FROM range(-1, 2) p(x), range(-1, 2) q(y)), m AS (SELECT a.row, a.col, min(b.shadow) AS shadow FROM s a, d JOIN s b ON b.row = a.row + dr AND b.col = a.col + dc WHERE r2 <= 0.25 GROUP BY ALL)
SELECT a.row, a.col, max(b.shadow) AS shadow FROM m a, d JOIN m b ON b.row = a.row + dr AND b.col = a.col + dc WHERE r2 <= 2.25 GROUP BY ALL""")
def shadow_project(g: DataFrame) -> DataFrame:
    clouds = g.where("z > 6000").select("row", "col")
    dark = g.select("row", "col", (F.col("z") < 3000).cast("int").alias("dark"))
    return L.project_shadows(clouds, dark, 135.0, 40.0, [30, 60, 90], 30.0, 0.5, 1.5).select("row", "col", "shadow")


PATCH = """WITH RECURSIVE c AS (SELECT row, col, row * 10 + col AS id, (z > 2000)::INTEGER AS v FROM grid), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.v = b.v AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), p AS (SELECT id, min(root) AS patch FROM r GROUP BY id)"""


@query("WITH RECURSIVE grid AS (SELECT s_suppkey // 10 AS row, s_suppkey % 10 AS col, s_acctbal AS z FROM supplier)," + PATCH.removeprefix("WITH RECURSIVE") + " SELECT row, col, v, count(*) OVER (PARTITION BY patch) AS n FROM c JOIN p USING (id)", obs=False)
def patch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).select("row", "col", (F.col("z") > 2000).cast("int").alias("v"))
    return patches.patch_sizes(g, "v")


SIEVE = """e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.v = b.v AND a.id <> b.id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), p AS (SELECT id, count(*) AS n FROM r GROUP BY id)"""


@query(f"""WITH RECURSIVE grid AS (SELECT s_suppkey // 10 AS row, s_suppkey % 10 AS col, s_acctbal AS z FROM supplier), c AS (SELECT row, col, row * 10 + col AS id, (z > 2000)::INTEGER AS v FROM grid), {SIEVE},
m AS (SELECT a.id, b.v, count(*) AS k FROM c a JOIN c b ON (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4 GROUP BY ALL), q AS (SELECT id, arg_max(v, k * 2 - v) AS mode FROM m GROUP BY id)
SELECT row, col, CASE WHEN n <= 4 THEN mode ELSE v END AS v FROM c JOIN p USING (id) JOIN q USING (id)""", obs=False)
def sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of four cells or fewer take the commonest value nearby, of equally common ones the least."""
    return patches.sieve(grid(spark, sf_dir).select("row", "col", (F.col("z") > 2000).cast("int").alias("v")), "v", 4)


_HALVES = {0: ("dc <= 0", "dc >= 0"), 1: ("dr <= dc", "dr >= dc"), 2: ("dr <= 0", "dr >= 0"), 3: ("dr + dc <= 0", "dr + dc >= 0")}
_ENDS = {0: ((0, -1), (0, 1)), 1: ((-1, 1), (1, -1)), 2: ((-1, 0), (1, 0)), 3: ((-1, -1), (1, 1))}
_M = lambda p: f"m{p[0] + 1}{p[1] + 1}"
_STEEP = [f"abs({_M(p)} - {_M(q)})" for p, q in _ENDS.values()]


@query(f"""WITH nb AS (SELECT a.row, a.col, x AS dr, y AS dc, b.z + 2000 AS v FROM grid a, range(-3, 4) p(x), range(-3, 4) q(y) JOIN grid b ON b.row = a.row + x AND b.col = a.col + y),
st AS (SELECT row, col, i, j, avg(v) AS m, var_pop(v) AS s FROM nb, range(-1, 2) p(i), range(-1, 2) q(j) WHERE abs(dr - 2 * i) <= 1 AND abs(dc - 2 * j) <= 1 GROUP BY ALL),
noise AS (SELECT row, col, avg(r) AS noise FROM (SELECT row, col, s / (m * m) AS r FROM st QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY r) <= 5) GROUP BY ALL),
raw AS (SELECT row, col, {", ".join(f"max(m) FILTER (WHERE i = {i} AND j = {j}) AS c{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))} FROM st GROUP BY ALL),
m AS (SELECT row, col, {", ".join(f"coalesce(c{i}{j}, c11) AS m{i}{j}" for i in range(3) for j in range(3))} FROM raw),
g AS (SELECT *, list_position([{", ".join(_STEEP)}], greatest({", ".join(_STEEP)})) - 1 AS g FROM m),
t AS (SELECT *, CASE g {" ".join(f"WHEN {k} THEN abs({_M(p)} - m11) < abs({_M(q)} - m11)" for k, (p, q) in _ENDS.items())} END AS early FROM g),
h AS (SELECT nb.row, nb.col, avg(v) AS mean, var_pop(v) AS var FROM nb JOIN t ON t.row = nb.row AND t.col = nb.col
  WHERE CASE g {" ".join(f"WHEN {k} THEN CASE WHEN early THEN {p} ELSE {q} END" for k, (p, q) in _HALVES.items())} END GROUP BY ALL),
b AS (SELECT h.*, greatest((var - mean * mean * noise) / (noise + 1), 0) AS signal FROM h JOIN noise USING (row, col))
SELECT b.row, b.col, round(mean + coalesce(signal / nullif(var, 0), 0) * (z + 2000 - mean), 6) AS z FROM b JOIN grid ON grid.row = b.row AND grid.col = b.col""")
def lee_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined Lee filter of the surface, shifted to be positive."""
    g = grid(spark, sf_dir).select("row", "col", (F.col("z") + 2000).alias("z"))
    return rounded(L.lee_filter(g, "z"), ["row", "col"], ["z"])


@grid_query("""WITH k AS (SELECT r AS dr, CASE WHEN r < 0 THEN 1 ELSE -1 END * ((abs(r) + 2) // 4) - 4 + c AS dc FROM range(-20, 21) a(r), range(9) b(c) WHERE (abs(r) + 2) % 4 <> 3),
n AS (SELECT a.row, a.col, count(*) FILTER (WHERE b.z > 0) AS n FROM grid a, k JOIN grid b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL)
SELECT grid.row, grid.col, CASE WHEN n >= 20 THEN z END AS z FROM grid LEFT JOIN n ON n.row = grid.row AND n.col = grid.col""")
def defringe_slanting(g: DataFrame) -> DataFrame:
    """The kernel of 41 x 41 cells for scan-line gaps."""
    rows = g.select("row", "col", "z", (F.col("z") > 0).alias("valid"))
    return L.defringe(rows, ["z"], "valid", 20, L.slanting()).select("row", "col", "z")


@grid_query("""WITH k AS (SELECT x AS dr, y AS dc, 3 - abs(x) - abs(y) AS w FROM range(-2, 3) a(x), range(-2, 3) b(y) WHERE abs(x) + abs(y) <= 2),
n AS (SELECT a.row, a.col, count(*) AS n, sum(w * b.z) AS s, sum(w * b.z) / sum(w) AS m, sum(w * b.z * b.z) / sum(w) AS q FROM grid a, k JOIN grid b ON b.row = a.row + dr AND b.col = a.col + dc WHERE b.z > 0 GROUP BY ALL)
SELECT grid.row, grid.col, coalesce(n.n, 0) AS n, round(s, 4) AS sum, round(m, 7) AS mean, round(greatest(q - m * m, 0), 4) AS variance FROM grid LEFT JOIN n ON n.row = grid.row AND n.col = grid.col""")
def kernel_statistics(g: DataFrame) -> DataFrame:
    """Mean and variance under a kernel of weights that fall with distance."""
    weights = {(a, b): 3.0 - abs(a) - abs(b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) <= 2}
    out = lines.statistics(g.select("row", "col", F.when(F.col("z") > 0, F.col("z")).alias("z")), "z", weights)
    return out.select("row", "col", "n", *[F.round(c, d).alias(c) for c, d in (("sum", 4), ("mean", 7), ("variance", 4))])


@grid_query("""WITH p AS (SELECT row + 0.25::DOUBLE AS y, col + 0.5::DOUBLE AS x FROM grid), n AS (SELECT y, x, floor(y) + i AS row, floor(x) + j AS col FROM p, range(0, 2) a(i), range(0, 2) b(j)),
m AS (SELECT n.y, n.x, (1 - abs(n.y - n.row)) * (1 - abs(n.x - n.col)) AS w, grid.z FROM n JOIN grid ON grid.row = n.row AND grid.col = n.col) SELECT y, x, round(sum(z * w) / sum(w), 6) AS z FROM m GROUP BY y, x""")
def resample_bilinear(g: DataFrame) -> DataFrame:
    points = g.select((F.col("row") + B.dbl(0.25)).alias("y"), (F.col("col") + B.dbl(0.5)).alias("x"))
    return rounded(L.bilinear(g, points, "z"), ["y", "x"], ["z"])


PAIRS = [(a, b) for i, a in enumerate(["red", "nir", "swir1"]) for b in ["red", "nir", "swir1"][i:]]


@obs_query(" UNION ALL ".join(f"SELECT '{a}' AS band_a, '{b}' AS band_b, round(covar_pop({a}, {b}), 8) AS cov FROM obs" for a, b in PAIRS))
def covariance_matrix(obs: DataFrame) -> DataFrame:
    return rounded(N.covariance(obs, ["red", "nir", "swir1"]), ["band_a", "band_b"], ["cov"], 8)


@obs_query()
def pca_bands(obs: DataFrame) -> DataFrame:
    """Three unit-variance components of four bands. Tested by their covariance, which must be the identity."""
    return rounded(N.principal_components(obs, ["red", "nir", "swir1", "swir2"]), KEYS, ["pc1", "pc2", "pc3"])


@obs_query("""WITH m AS (SELECT px, yr, avg(nir) FILTER (WHERE sensor = 'A') AS nir, avg(nir) FILTER (WHERE sensor = 'R') AS nir_m FROM obs GROUP BY px, yr), s AS (SELECT avg(nir - nir_m) AS a, stddev_pop(nir - nir_m) AS s FROM m),
p AS (SELECT m.*, coalesce(abs(nir - nir_m - a) <= s * 1, false) AS pif FROM m, s WHERE nir IS NOT NULL AND nir_m IS NOT NULL), r AS (SELECT regr_slope(nir_m, nir) AS b, regr_intercept(nir_m, nir) AS c FROM p WHERE pif)
SELECT px, yr, pif, round(nir * b + c, 6) AS nir_norm FROM p, r""")
def image_normalize(obs: DataFrame) -> DataFrame:
    mean = lambda s: F.avg(F.when(F.col("sensor") == s, F.col("nir")))
    both = obs.groupBy("px", "yr").agg(mean("A").alias("nir"), mean("R").alias("nir_m")).where("nir IS NOT NULL AND nir_m IS NOT NULL")
    return rounded(N.normalize(N.invariant(both, ["nir"], 1.0), ["nir"]), ["px", "yr", "pif"], ["nir_norm"])


@query("""WITH z AS (SELECT obs.nir, grid.zone FROM obs JOIN grid USING (px)) SELECT zone, round(avg(nir), 6) AS nir_mean, round(stddev_pop(nir), 6) AS "nir_stdDev", count(nir) AS nir_count FROM z GROUP BY zone""")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastertime.sources.observations import observations

    rows = observations(spark, sf_dir).join(grid(spark, sf_dir).select("px", "zone"), "px")
    out = C.zonal(rows, "zone", ["nir"], {"mean": F.avg, "stdDev": F.stddev_pop, "count": F.count})
    return rounded(out, ["zone", "nir_count"], ["nir_mean", "nir_stdDev"])


@query("SELECT c_custkey, s_suppkey AS px, s_acctbal AS z FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)", obs=False)
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).select("px", "z")
    n = cells.agg(F.count(F.lit(1)).alias("_n"))
    points = table(spark, sf_dir, "customer").select("c_custkey").join(F.broadcast(n)).select("c_custkey", (F.col("c_custkey") % F.col("_n")).alias("px"))
    return C.sample_points(cells, points, ["px"])


@query("SELECT n_name, n_nationkey, (dense_rank() OVER (ORDER BY r_name) - 1)::INTEGER AS code FROM nation JOIN region ON n_regionkey = r_regionkey", obs=False)
def names_to_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return C.names_to_numbers(rows, "r_name", "code").select("n_name", "n_nationkey", F.col("code").cast("int").alias("code"))


@obs_query("""WITH ic AS (SELECT *, blue * 4 + 0.2::DOUBLE AS ic, green * 100 AS slope FROM obs), f AS (SELECT sensor, regr_slope(nir, ic) AS s, regr_intercept(nir, ic) AS o FROM ic WHERE slope >= 5 AND ic >= 0 AND nir > -0.1 GROUP BY sensor),
l AS (SELECT px, ok, ln, pk, yr, doy, nir, ic, slope, o / NULLIF(s, 0) AS c, cos(radians(slope)) * cos(radians(35::DOUBLE)) AS lev FROM ic JOIN f USING (sensor))
SELECT px, ok, ln, pk, yr, doy, round(coalesce(CASE WHEN slope >= 5 AND ic >= 0 AND nir > -0.1 THEN nir * ((lev + c) / NULLIF(ic + c, 0)) END, nir), 6) AS nir FROM l""")
def illumination_correction(obs: DataFrame) -> DataFrame:
    rows = obs.withColumns({"IC": F.col("blue") * 4 + B.dbl(0.2), "slope": F.col("green") * 100})
    return rounded(L.illumination_correction(rows, ["nir"], "sensor", B.dbl(35)), KEYS, ["nir"])
