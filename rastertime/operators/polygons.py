"""Areas given by polygons: clipping, filtering and statistics of grid cells.

A polygon is an array of rings, a ring an array of points (x, y) in grid units: x runs along columns, y along rows, and a cell
lies at its whole numbers. A cell is inside if a ray from it crosses an odd number of the rings' edges, so holes and
islands need no marks, and neither order nor closing of a ring matters. Edges are half open, so a cell on a border that
two polygons share is in one of them.

Polygons are covered by square tiles, band of rows by band of rows. Cells meet polygons by an equi-join on the tile; a
tile without an edge is inside or outside as a whole, and only tiles with an edge test their cells, against the edges of
their band alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl

RINGS = "array<array<struct<x: double, y: double>>>"
#: Rows of a cover up to which it is broadcast.
COVER_ROWS = 50_000


def from_geojson(text: Column) -> Column:
    """Rings of a GeoJSON Polygon or MultiPolygon; NULL for other geometries and broken text."""
    kind, inner = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
    one = F.from_json(inner, "array<array<array<double>>>")
    many = F.flatten(F.from_json(inner, "array<array<array<array<double>>>>"))
    points = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return F.transform(points, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def edges(rings: Column, level: bool = False) -> Column:
    """The rings' edges, each from its lower end (x1, y1) to its upper (x2, y2); no ray crosses ``level`` ones."""

    def of(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        both = F.arrays_zip(ring.alias("a"), following.alias("b"))
        return F.transform(
            F.filter(both, lambda e: (e["a"]["y"] != e["b"]["y"]) | (F.lit(level) & (e["a"]["x"] != e["b"]["x"]))),
            lambda e: F.when(e["a"]["y"] < e["b"]["y"], _edge(e["a"], e["b"])).otherwise(_edge(e["b"], e["a"])),
        )

    return F.flatten(F.transform(F.coalesce(rings, F.array().cast(RINGS)), of))


def _edge(low: Column, high: Column) -> Column:
    return F.struct(low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2"))


def _at(e: Column, y: Column) -> Column:
    return e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])


def crossed(found: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) towards larger x crosses an odd number of edges."""
    hit = F.filter(found, lambda e: (e["y1"] <= y) & (y < e["y2"]) & (x < _at(e, y)))
    return F.size(hit) % 2 == 1


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) is in the polygon."""
    return crossed(edges(rings), x, y)


def bounds(rings: Column) -> Column:
    """The box (low_x, low_y, high_x, high_y) of a polygon."""
    points = F.flatten(rings)
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("low_x"), of(F.array_min, "y").alias("low_y"), of(F.array_max, "x").alias("high_x"), of(F.array_max, "y").alias("high_y"))


def area(rings: Column) -> Column:
    """Square units inside, where rings don't cross one another: rings within an odd number of others count as holes."""

    def doubled(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.aggregate(F.arrays_zip(ring.alias("a"), following.alias("b")), dbl(0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])

    def depth(i: Column) -> Column:  # of a ring in the others, by its first point
        others = F.filter(F.sequence(F.lit(0), F.size(rings) - 1), lambda j: j != i)
        first = F.get(F.get(rings, i), F.lit(0))
        return F.size(F.filter(others, lambda j: inside(F.array(F.get(rings, j)), first["x"], first["y"])))

    each = F.transform(F.sequence(F.lit(0), F.size(rings) - 1), lambda i: F.abs(doubled(F.get(rings, i))) / dbl(2) * F.when(depth(i) % 2 == 1, -1).otherwise(1))
    return F.when(F.size(rings) > 0, F.aggregate(each, dbl(0), lambda s, a: s + a))


def cover(polygons: DataFrame, keys: list[str], rings: str = "rings", tile: int = 64) -> DataFrame:
    """(keys, tile_row, tile_col, near): the tiles that a polygon may have cells in.

    near is NULL where the whole tile is inside, else the edges that a ray from one of its cells may cross. Bands of rows
    come first, so a long slanting polygon gives the tiles along it, not those of its box.
    """
    found = polygons.select(*keys, edges(F.col(rings), level=True).alias("_e")).where(F.size("_e") > 0)
    low, high = F.array_min(F.transform("_e", lambda e: e["y1"])), F.array_max(F.transform("_e", lambda e: e["y2"]))
    band = lambda y: F.floor((y + dbl(0.5)) / tile)  # noqa: E731  a tile reaches half a cell beyond its outer cells
    rows = found.withColumn("tile_row", F.explode(F.sequence(band(low), band(high))))
    bottom, top = F.col("tile_row") * tile - dbl(0.5), F.col("tile_row") * tile + dbl(tile - 0.5)

    def reach(e: Column) -> Column:  # the columns that an edge has within the band
        level = e["y1"] == e["y2"]
        a = F.when(level, e["x1"]).otherwise(_at(e, F.greatest(e["y1"], bottom)))
        b = F.when(level, e["x2"]).otherwise(_at(e, F.least(e["y2"], top)))
        return F.struct(e["x1"], e["y1"], e["x2"], e["y2"], F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))

    rows = rows.withColumn("_e", F.transform(F.filter("_e", lambda e: (e["y1"] <= top) & (e["y2"] >= bottom)), reach)).where(F.size("_e") > 0)
    left, right = F.array_min(F.transform("_e", lambda e: e["low"])), F.array_max(F.transform("_e", lambda e: e["high"]))
    tiles = rows.withColumn("tile_col", F.explode(F.sequence(band(left), band(right))))
    start, end = F.col("tile_col") * tile - dbl(0.5), F.col("tile_col") * tile + dbl(tile - 0.5)
    slack = dbl(1e-6)
    cut = F.exists("_e", lambda e: (e["low"] <= end + slack) & (e["high"] >= start - slack))
    near = F.transform(F.filter("_e", lambda e: (e["high"] >= start - slack) & (e["y1"] < e["y2"])), _edge_of)
    tiles = tiles.withColumns({"_cut": cut, "near": near})
    whole = crossed(F.col("near"), (F.col("tile_col") * tile).cast("double"), (F.col("tile_row") * tile).cast("double"))
    return tiles.where(F.col("_cut") | whole).select(*keys, "tile_row", "tile_col", F.when(F.col("_cut"), F.col("near")).alias("near"))


def _edge_of(e: Column) -> Column:
    return F.struct(*[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


def covered(df: DataFrame, polygons: DataFrame, keys: list[str], rings: str = "rings", tile: int = 64, how: str = "inner") -> DataFrame:
    """Every row of ``df`` (row, col, ...) with the keys of each polygon that its cell is in; ``how`` may be left_semi.

    Polygons without rings, or with NULL ones, hold no cell. The cover is broadcast up to COVER_ROWS tiles, and joined by
    shuffle beyond; many rows of one tile are then split by adaptive execution. Keys that ``df`` has too are not allowed.
    """
    if how == "inner" and set(keys) & set(df.columns):
        raise ValueError(f"columns {sorted(set(keys) & set(df.columns))} are in both tables")
    tiles = cover(polygons.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], rings), [f"_k{i}" for i in range(len(keys))], rings, tile)
    tiles = tiles.withColumnsRenamed({"tile_row": "_tile_row", "tile_col": "_tile_col", "near": "_near"})
    if tiles.limit(COVER_ROWS + 1).count() <= COVER_ROWS:
        tiles = F.broadcast(tiles)
    in_tile = (F.floor(F.col("row") / tile) == F.col("_tile_row")) & (F.floor(F.col("col") / tile) == F.col("_tile_col"))
    hit = F.col("_near").isNull() | crossed(F.col("_near"), F.col("col").cast("double"), F.col("row").cast("double"))
    if how == "left_semi":
        return df.join(tiles, in_tile & hit, "left_semi")
    return df.join(tiles, in_tile).where(hit).select(*df.columns, *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)])


def clip(df: DataFrame, polygons: DataFrame, rings: str = "rings", tile: int = 64) -> DataFrame:
    """The rows whose cell is in any polygon, each once."""
    return covered(df, polygons, [], rings, tile, "left_semi")


def images_in(df: DataFrame, polygons: DataFrame, image: list[str], rings: str = "rings", tile: int = 64) -> DataFrame:
    """All rows of the images that have a cell in any polygon."""
    return df.join(clip(df.select(*image, "row", "col"), polygons, rings, tile).select(*image).distinct(), image, "left_semi")


def reduce_regions(df: DataFrame, polygons: DataFrame, keys: list[str], reducers: dict[str, Column], rings: str = "rings", tile: int = 64) -> DataFrame:
    """A row per polygon: its keys and ``reducers`` over the rows whose cells it holds, NULL or 0 where it holds none.

    A polygon is named by its keys: several rows of one name are one area. Sums are partial before the shuffle, so a
    polygon that holds most cells is no hot spot.
    """
    made = covered(df, polygons, keys, rings, tile).groupBy(*keys).agg(*[e.alias(n) for n, e in reducers.items()])
    names = polygons.select(*keys).distinct()
    same = None
    for k in keys:
        one = names[k].eqNullSafe(made[k])
        same = one if same is None else same & one
    return names.join(made, same, "left").select(*[names[k] for k in keys], *reducers)
