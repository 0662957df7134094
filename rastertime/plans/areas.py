"""Queries of polygon areas. Each supplier has a polygon around its cell: a hull, a hole, and an island beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl
from rastertime.operators import classification as K
from rastertime.operators import polygons as P
from rastertime.plans.registry import KEYS, KEYS_SQL, query, rounded
from rastertime.sources.observations import grid, observations, table

#: Offsets (x, y) of the rings from a cell, exact in binary.
HULL = [(-1.5, -1.25), (2.25, -0.75), (1.5, 2.0), (-0.75, 1.5)]
HOLE = [(-0.5, -0.5), (0.75, -0.5), (0.25, 0.75)]
ISLAND = [(3.0, -1.0), (4.5, 0.25), (3.0, 1.0)]
SHAPE = [HULL, HOLE, ISLAND]


def _rings(x, y):
    return F.array(*[F.array(*[F.struct((x + dbl(a)).alias("x"), (y + dbl(b)).alias("y")) for a, b in ring]) for ring in SHAPE])


def _edge_rows() -> str:
    rows = [(a, b, c, d) for ring in SHAPE for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]]) if b != d]
    rows = [(a, b, c, d) if b < d else (c, d, a, b) for a, b, c, d in rows]
    return ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in rows)


#: holds (area, px): the cells in the polygon of supplier ``area``.
HOLDS = f"""edge AS (SELECT * FROM (VALUES {_edge_rows()}) AS t(x1, y1, x2, y2)),
holds AS (SELECT a.px AS area, c.px, c.row, c.col, c.z FROM grid a, grid c, edge e
  WHERE a.row + e.y1 <= c.row AND c.row < a.row + e.y2 AND c.col < (a.col + e.x1) + (c.row - (a.row + e.y1)) * ((a.col + e.x2) - (a.col + e.x1)) / ((a.row + e.y2) - (a.row + e.y1))
  GROUP BY ALL HAVING count(*) % 2 = 1)"""


def areas(g: DataFrame) -> DataFrame:
    return g.select(F.col("px").alias("area"), F.col("zone").alias("nation"), _rings(F.col("col"), F.col("row")).alias("rings"))


@query(f"""WITH {HOLDS} SELECT g.px AS area, count(h.px) AS n, round(avg(h.z), 6) AS mean, max(h.z) AS most, round(stddev_pop(h.z), 6) AS sd FROM grid g LEFT JOIN holds h ON h.area = g.px GROUP BY g.px""")
def region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a surface in every polygon; polygons overlap."""
    g = grid(spark, sf_dir)
    made = {"n": F.count("px"), "mean": F.avg("z"), "most": F.max("z"), "sd": F.stddev_pop("z")}
    out = P.reduce_regions(g.select("px", "row", "col", "z"), areas(g), ["area"], made, tile=4)
    return out.select("area", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round("mean", 6).alias("mean"), "most", F.round("sd", 6).alias("sd"))


@query(f"""WITH {HOLDS}, chosen AS (SELECT DISTINCT h.px FROM holds h JOIN grid a ON a.px = h.area JOIN nation ON n_nationkey = a.zone WHERE n_regionkey = 1)
SELECT {KEYS_SQL}, round(nir, 9) AS nir FROM obs WHERE px IN (SELECT px FROM chosen)""")
def clip_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations within the polygons of one region."""
    chosen = areas(grid(spark, sf_dir)).join(table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("nation") == F.col("n_nationkey"), "left_semi")
    return rounded(P.clip(observations(spark, sf_dir), chosen, tile=8), KEYS, ["nir"], 9)


@query(f"""WITH {HOLDS}, scene AS (SELECT DISTINCT yr, ln, doy FROM obs JOIN holds h ON h.px = obs.px JOIN grid a ON a.px = h.area WHERE a.zone = 3)
SELECT o.yr, o.ln, o.doy, count(*) AS n, round(avg(o.red), 9) AS red FROM obs o JOIN scene s ON s.yr = o.yr AND s.ln = o.ln AND s.doy = o.doy GROUP BY ALL""")
def filter_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole images, of a day and a line number, that touch the polygons of one nation."""
    found = P.images_in(observations(spark, sf_dir), areas(grid(spark, sf_dir)).where("nation = 3"), ["yr", "ln", "doy"], tile=8)
    return rounded(found.groupBy("yr", "ln", "doy").agg(F.count(F.lit(1)).alias("n"), F.avg("red").alias("red")), ["yr", "ln", "doy", "n"], ["red"], 9)


@query("""SELECT px, px // 10 // 3 * 1000 + px % 10 // 3 * 10 + CASE WHEN px % 10 - px % 10 // 3 * 3 < px // 10 - px // 10 // 3 * 3 THEN 1 ELSE 0 END AS part FROM (SELECT s_suppkey AS px FROM supplier)""", obs=False)
def shared_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles that share all borders, which run through cells: every cell is in just one."""
    g = grid(spark, sf_dir)
    squares = g.select((F.col("row") / 3).cast("long").alias("r"), (F.col("col") / 3).cast("long").alias("c")).distinct()
    x, y = (F.col("c") * 3).cast("double"), (F.col("r") * 3).cast("double")
    point = lambda dx, dy: F.struct((x + dbl(dx)).alias("x"), (y + dbl(dy)).alias("y"))
    halves = F.array(F.struct(F.lit(0).alias("half"), F.array(F.array(point(0, 0), point(3, 0), point(3, 3))).alias("rings")), F.struct(F.lit(1).alias("half"), F.array(F.array(point(0, 0), point(3, 3), point(0, 3))).alias("rings")))
    parts = squares.select("r", "c", F.explode(halves).alias("h")).select((F.col("r") * 1000 + F.col("c") * 10 + F.col("h.half")).alias("part"), "h.rings")
    return P.covered(g.select("px", "row", "col"), parts, ["part"], tile=4).select("px", "part")


#: Features of cells: means over their observations.
_FEATURES = "feat AS (SELECT px, row, col, avg(nir) AS nir, avg(red) AS red, avg(swir1) AS swir1 FROM obs GROUP BY ALL)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("px", "row", "col").agg(F.avg("nir").alias("nir"), F.avg("red").alias("red"), F.avg("swir1").alias("swir1"))


@query(f"""WITH {_FEATURES}, nm AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS code FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN grid ON zone = n_nationkey WHERE px % 3 = 0)),
tr AS (SELECT code, nir, red, swir1 FROM feat JOIN grid USING (px) JOIN nation ON n_nationkey = zone JOIN region ON r_regionkey = n_regionkey JOIN nm USING (r_name) WHERE px % 3 = 0),
ct AS (SELECT code, avg(nir) AS a, avg(red) AS b, avg(swir1) AS c FROM tr GROUP BY code)
SELECT px, code::BIGINT AS classified FROM feat, ct QUALIFY row_number() OVER (PARTITION BY px ORDER BY round((nir - a) ** 2 + (red - b) ** 2 + (swir1 - c) ** 2, 9), code) = 1""")
def classify_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the nearest centre of the regions, whose names are learned at every third cell."""
    cells, features = _features(spark, sf_dir), ["nir", "red", "swir1"]
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    points = grid(spark, sf_dir).where("px % 3 = 0").join(nations, F.col("zone") == F.col("n_nationkey")).select("px", "r_name")
    training, number = K.training_points(cells, points, ["px"], "r_name", features)
    return K.nearest_centre(cells, K.centres(training, features, number), features).select("px", "classified")


@query(f"""WITH {HOLDS}, {_FEATURES}, zf AS (SELECT h.area, avg(nir) AS nir, max(red) AS red, count(*) AS n FROM holds h JOIN feat f ON f.px = h.px GROUP BY h.area),
ct AS (SELECT zone % 4 AS code, avg(nir) AS a, avg(red) AS b FROM zf JOIN grid ON grid.px = area WHERE area % 2 = 0 GROUP BY 1)
SELECT g.px AS area, coalesce(n, 0) AS n, (arg_min(code, (round((nir - a) ** 2 + (red - b) ** 2, 9), code)))::BIGINT AS classified FROM grid g LEFT JOIN zf ON zf.area = g.px LEFT JOIN ct ON zf.area IS NOT NULL WHERE g.px % 2 = 1 GROUP BY g.px, n""")
def classify_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons with odd numbers by the nearest centre of classes that are learned from the even ones' zonal features."""
    cells, all_ = _features(spark, sf_dir), areas(grid(spark, sf_dir)).withColumn("class", F.col("nation") % 4)
    made = {"nir": F.avg("nir"), "red": F.max("red"), "n": F.count("px")}
    training, number = K.training_polygons(cells, all_.where("area % 2 = 0"), ["area"], "class", made, tile=4)
    zones = P.reduce_regions(cells, all_.where("area % 2 = 1"), ["area"], made, tile=4)
    out = K.nearest_centre(zones, K.centres(training, ["nir", "red"], number), ["nir", "red"])
    return out.select("area", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("classified").cast("long").alias("classified"))


@query()
def classify_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of light of each cell's observations, learned by a forest at cells with even numbers: a label that follows the features."""
    cells = _features(spark, sf_dir).withColumn("bright", F.when(F.col("nir") > 0.35, "high").otherwise("low"))
    _, out = K.classified_points(cells, cells.where("px % 2 = 0").select("px", "bright"), ["px"], "bright", ["nir", "red", "swir1"], trees=15, depth=4, seed=7)
    return out.select("px", "bright", "classified")
