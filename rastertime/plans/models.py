"""Queries of the iterative models. SQL can't express them: they are tested on synthetic signals."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.functions import segments as S
from rastertime.operators import charts as A
from rastertime.operators import classify as C
from rastertime.operators import models as M
from rastertime.operators import registration as G
from rastertime.plans.history import CLEAR, annual, clear
from rastertime.plans.registry import obs_query, query, rounded
from rastertime.plans.space import grid_query
from rastertime.sources.observations import grid, table


def _decimal(obs: DataFrame) -> DataFrame:
    return obs.withColumn("t_dec", F.col("yr").cast("double") + F.col("doy").cast("double") / F.lit(365.0))


@obs_query()
def landtrendr(obs: DataFrame) -> DataFrame:
    """Largest loss and gain of each pixel's segmented yearly NDVI, turned so that loss goes up."""
    lt = M.landtrendr(annual(obs), "v", ["px"], direction=-1)
    v = S.scaled(S.vertices(F.col("lt")), -1)
    wide = S.top(S.loss_gain(v, "loss", mag=-0.02, slope=-0.01), 1, "loss") | S.top(S.loss_gain(v, "gain", mag=0.02, slope=0.01), 1, "gain")
    return lt.select("px", F.size(S.vertices(F.col("lt"))).alias("n_vertices"), F.round("rmse", 6).alias("rmse"), *[(F.round(c, 6) if "_mag_" in n or "_slope_" in n else c).alias(n) for n, c in wide.items()])


@obs_query()
def verdet(obs: DataFrame) -> DataFrame:
    """Vertices and slopes of a curvature-penalised line through yearly NDVI."""
    out = M.verdet(annual(obs), "v", ["px"], (1995, 2001))
    return out.select("px", F.size("vertices").alias("n_vertices"), F.transform("slopes", lambda s: F.round(s, 6)).alias("slopes"))


def _line(own: str, name: str) -> str:
    """{name} (px, b0, b1, b2): least squares of v on 1, c, s over the rows of o where ``own``, by Cramer's rule."""
    m = f"SELECT px, count(*) AS n, sum(c) AS c, sum(s) AS s, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(v) AS v, sum(c * v) AS cv, sum(s * v) AS sv FROM {own} GROUP BY px"
    det = lambda a, b, c, d, e, f, g, h, i: f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    d = det("n", "c", "s", "c", "cc", "cs", "s", "cs", "ss")
    parts = (det("v", "c", "s", "cv", "cc", "cs", "sv", "cs", "ss"), det("n", "v", "s", "c", "cv", "cs", "s", "sv", "ss"), det("n", "c", "v", "c", "cc", "cv", "s", "cs", "sv"))
    return f"{name} AS (SELECT px, n, " + ", ".join(f"{x} / nullif({d}, 0) AS b{i}" for i, x in enumerate(parts)) + f" FROM ({m}))"


_LEFT = "v - (b0 + b1 * c + b2 * s)"


@obs_query(f"""WITH q AS (SELECT px, yr::DOUBLE + doy::DOUBLE / 365.0::DOUBLE AS t, (nir - red) / (nir + red) AS v FROM obs WHERE {CLEAR}),
o AS (SELECT *, cos(2 * pi() * t) AS c, sin(2 * pi() * t) AS s, t >= 1995 AND t < 1997 AS own FROM q WHERE v > -1),
o1 AS (SELECT * FROM o WHERE own), {_line("o1", "f1")}, r1 AS (SELECT o.*, {_LEFT} AS r FROM o JOIN f1 USING (px) WHERE n >= 5), d1 AS (SELECT px, stddev_samp(r) FILTER (WHERE own) AS sd FROM r1 GROUP BY px),
o2 AS (SELECT r1.* EXCLUDE (r) FROM r1 JOIN d1 USING (px) WHERE own AND abs(r) <= 3 * sd), {_line("o2", "f2")},
r2 AS (SELECT r1.px, r1.t, r1.v, {_LEFT.replace("v -", "r1.v -").replace("* c", "* r1.c").replace("* s", "* r1.s")} AS r, row_number() OVER (PARTITION BY r1.px ORDER BY r1.t, r1.v) AS i FROM r1 JOIN f2 USING (px)),
d2 AS (SELECT o2.px, stddev_samp({_LEFT}) AS sd FROM o2 JOIN f2 USING (px) GROUP BY o2.px),
z AS (SELECT px, t, i, pow(0.7::DOUBLE, i) * sum(0.3::DOUBLE * r * pow(0.7::DOUBLE, -i)) OVER (PARTITION BY px ORDER BY i) AS z FROM r2),
e AS (SELECT z.px, t, trunc(z / (3 * sd * sqrt(0.3::DOUBLE / 1.7::DOUBLE * (1 - pow(0.7::DOUBLE, 2 * i))))) AS ewma FROM z JOIN d2 USING (px))
SELECT o.px, floor(o.t)::INTEGER AS yr, min(e.ewma) AS ewma FROM o LEFT JOIN e ON e.px = o.px AND e.t = o.t GROUP BY 1, 2""")
def ewmacd(obs: DataFrame) -> DataFrame:
    """Yearly lowest value of the control chart of NDVI residuals."""
    rows = _decimal(clear(obs)).withColumn("v", (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red")))
    return A.annual_ewma(A.ewmacd(rows, "v", ["px"], (1995, 1996)), ["px"])


@obs_query()
def verdet_annual(obs: DataFrame) -> DataFrame:
    """Annual values of the curvature-penalised lines of two bands, side by side."""
    rows = annual(obs)
    both = M.verdet(rows, "v", ["px"], (1995, 2001)).select("px", F.col("vertices").alias("v")).join(M.verdet(rows, "nir", ["px"], (1995, 2001)).select("px", F.col("vertices").alias("n")), "px")
    out = S.annual_many(both, {"NDVI": "v", "NIR": "n"}, 1995, 2001, ["px"], "VT")
    return rounded(out, ["px", "year", "NDVI_VT_dur", "NIR_VT_dur"], [f"{b}_VT_{f}" for b in ("NDVI", "NIR") for f in ("fit", "mag", "slope", "diff")])


@obs_query()
def ccdc(obs: DataFrame) -> DataFrame:
    """Segments of the continuous-change model on two bands, with the magnitude and coefficients of each."""
    bands = ["nir", "swir1"]
    s = M.ccdc(_decimal(clear(obs)), bands, ["px"]).select("px", F.posexplode("segs").alias("i", "s")).select("px", "i", "s.*")
    own = {f"{b}_magnitude": F.round(F.col("mag")[b], 6) for b in bands} | {f"{b}_coefs": F.transform(F.col("coefs")[b], lambda c: F.round(c, 6)) for b in bands}
    return s.select("px", "i", *[F.round(c, 6).alias(c) for c in ("tStart", "tEnd", "tBreak", "changeProb")], *[c.alias(n) for n, c in own.items()])


@query()
def snic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels of the supplier grid."""
    g = grid(spark, sf_dir).select("row", "col", (F.col("z") / 10000).alias("z"))
    return M.snic(g, ["z"], 5, 1.0)


@query()
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding labels from a forest on every component, fitted on rows whose hash falls in the training share."""
    whole = ~F.exists("embedding", lambda x: x.isNull())
    vector = F.when(whole, array_to_vector(F.col("embedding").cast("array<double>"))).alias("e")
    rows = table(spark, sf_dir, "embeddings").where(whole).select("vec_id", F.col("label").cast("double").alias("label"), vector)
    train = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(10)) < 7)
    return C.random_forest(train, rows, ["e"], "label").select("vec_id", "label", "classified")


#: found (grp, image, tile_row, tile_col, dr, dc, r): the best shift of every tile of images i (grp, image, row, col, z) against ref (grp, row, col, z).
def _found(tile: int, most: int) -> str:
    return f"""v AS (SELECT grp, floor(row / {tile}::DOUBLE)::BIGINT AS tile_row, floor(col / {tile}::DOUBLE)::BIGINT AS tile_col, count(z) AS valid FROM ref GROUP BY ALL),
tried AS (SELECT i.grp, i.image, floor(b.row / {tile}::DOUBLE)::BIGINT AS tile_row, floor(b.col / {tile}::DOUBLE)::BIGINT AS tile_col, dr, dc, corr(b.z, i.z) AS r, count(*) AS n FROM ref b, range({-most}, {most + 1}) p(dr), range({-most}, {most + 1}) q(dc)
  JOIN i ON i.grp = b.grp AND i.row = b.row + dr AND i.col = b.col + dc GROUP BY ALL),
found AS (SELECT t.* FROM tried t JOIN v USING (grp, tile_row, tile_col) WHERE isfinite(r) AND n * 2 >= valid
  QUALIFY row_number() OVER (PARTITION BY t.grp, image, tile_row, tile_col ORDER BY round(r, 9) DESC, dr * dr + dc * dc, dr, dc) = 1)"""


@grid_query(f"""WITH ref AS (SELECT 0 AS grp, row, col, z FROM grid), i AS (SELECT 0 AS grp, 1 AS image, row, col + 1 AS col, z FROM grid), {_found(16, 3)}
SELECT image, tile_row, tile_col, dr::INTEGER AS dr, dc::INTEGER AS dc, round(r, 6) AS r FROM found""")
def registration(g: DataFrame) -> DataFrame:
    """Shift of a moved copy of the grid against the grid, by tile."""
    g = g.select("row", "col", "z")
    moved = g.select(F.lit(1).alias("image"), "row", (F.col("col") + 1).alias("col"), "z")
    return rounded(G.shifts(moved, g, "z", tile=16, most=3, coarse=1), ["image", "tile_row", "tile_col", "dr", "dc"], ["r"])


#: Images of two groups: each shows the surface, moved by its own rows and columns and brighter by its number.
_SCENES = """k AS (SELECT i AS image, i % 2 AS grp, i // 2 AS day, (i * 2 + 1) % 3 - 1 AS mr, (i * 3) % 4 - 1 AS mc FROM range(6) t(i)),
imgs AS (SELECT k.image, k.grp, k.day, grid.row + mr AS row, grid.col + mc AS col, z + 10 * k.image AS z, (z + 10 * k.image) * 2 AS w FROM k, grid),
ref AS (SELECT * FROM imgs WHERE day = 0), i AS (SELECT * FROM imgs WHERE day > 0)"""


@grid_query(f"""WITH {_SCENES}, {_found(10, 2)}
SELECT 'g' || grp AS orbit, image, row, col, z, w FROM ref UNION ALL
SELECT 'g' || a.grp, a.image, a.row, a.col, b.z, b.w FROM i a LEFT JOIN found f ON f.image = a.image AND f.tile_row = floor(a.row / 10::DOUBLE) AND f.tile_col = floor(a.col / 10::DOUBLE)
  LEFT JOIN i b ON b.image = a.image AND b.row = a.row + coalesce(dr, 0) AND b.col = a.col + coalesce(dc, 0)""")
def co_register_groups(g: DataFrame) -> DataFrame:
    """Images of two orbits, each moved onto the first of its orbit."""
    k = g.withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({"orbit": F.concat(F.lit("g"), F.col("image") % 2), "day": (F.col("image") / 2).cast("int"), "z": F.col("z") + F.col("image") * 10})
    images = k.select("image", "orbit", "day", (F.col("row") + (F.col("image") * 2 + 1) % 3 - 1).alias("row"), (F.col("col") + (F.col("image") * 3) % 4 - 1).alias("col"), "z", (F.col("z") * 2).alias("w"))
    return G.co_registered_groups(images, "z", ["z", "w"], "orbit", "day", tile=10, most=2, coarse=1)


@grid_query("""WITH t AS (SELECT DISTINCT row // 4 AS tr, col // 4 AS tc FROM grid), o AS (SELECT tr, tc, (tr % 3)::DOUBLE / 7 AS dr, tc::DOUBLE / 3 - 1 AS dc FROM t),
s AS (SELECT a.tr, a.tc, avg(b.dr) AS dr, avg(b.dc) AS dc FROM o a JOIN o b ON abs(a.tr - b.tr) <= 1 AND abs(a.tc - b.tc) <= 1 GROUP BY ALL),
w AS (SELECT row, col, s.dr, s.dc, greatest(1 - abs((row + 0.5::DOUBLE) / 4 - 0.5::DOUBLE - tr), 0) * greatest(1 - abs((col + 0.5::DOUBLE) / 4 - 0.5::DOUBLE - tc), 0) AS w FROM grid JOIN s ON abs(row // 4 - tr) <= 1 AND abs(col // 4 - tc) <= 1),
f AS (SELECT row, col, row + round(sum(w * dr) / sum(w), 9) AS y, col + round(sum(w * dc) / sum(w), 9) AS x FROM w GROUP BY row, col),
n AS (SELECT f.row, f.col, b.z, (1 - abs(y - b.row)) * (1 - abs(x - b.col)) AS w FROM f LEFT JOIN grid b ON b.row BETWEEN floor(y) AND ceil(y) AND b.col BETWEEN floor(x) AND ceil(x))
SELECT 1 AS image, row, col, round(sum(w * z) / nullif(sum(w), 0), 7) AS z FROM n GROUP BY row, col""")
def displacement_field(g: DataFrame) -> DataFrame:
    """The surface moved by a field that is interpolated and smoothed from a ramp of tile shifts."""
    image = g.select(F.lit(1).alias("image"), "row", "col", "z")
    tiles = image.select("image", F.floor(F.col("row") / 4).alias("tile_row"), F.floor(F.col("col") / 4).alias("tile_col")).distinct()
    offsets = tiles.withColumns({"dr": (F.col("tile_row") % 3).cast("double") / 7, "dc": F.col("tile_col").cast("double") / 3 - 1})
    return rounded(G.displaced_by_field(image, offsets, ["z"], tile=4), ["image", "row", "col"], ["z"], 7)


@grid_query("""WITH shifts AS (SELECT row, col, (row // 2) % 2 AS dr, (col // 2) % 4 - 1 AS dc FROM grid)
SELECT 1 AS image, a.row, a.col, b.z FROM shifts a LEFT JOIN grid b ON b.row = a.row + CASE WHEN dc < 2 THEN dr ELSE 0 END AND b.col = a.col + CASE WHEN dc < 2 THEN dc ELSE 0 END""")
def displacement(g: DataFrame) -> DataFrame:
    """The grid moved by offsets of its tiles; those of two cells are too large and stay out."""
    image = g.select(F.lit(1).alias("image"), "row", "col", "z")
    tiles = image.select("image", F.floor(F.col("row") / 2).alias("tile_row"), F.floor(F.col("col") / 2).alias("tile_col")).distinct()
    offsets = tiles.withColumns({"dr": F.col("tile_row") % 2, "dc": F.col("tile_col") % 4 - 1})
    return G.displaced(image, offsets, ["z"], tile=2, most=1)
