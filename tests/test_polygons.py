"""Polygons against plain ray casting in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rastertime.operators import polygons as P


def plain_inside(rings, x, y):
    n = 0
    for ring in rings:
        for (a, b), (c, d) in zip(ring, [*ring[1:], *ring[:1]]):
            if b > d:
                a, b, c, d = c, d, a, b
            if b <= y < d and x < a + (y - b) * (c - a) / (d - b):
                n += 1
    return n % 2 == 1


def table_of(spark, shapes):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes.items()]
    return spark.createDataFrame(rows, f"k int, rings {P.RINGS}")


def cells(spark, rows=40, cols=30, low=-6):
    return spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col")).select((F.col("row") + low).alias("row"), (F.col("col") + low).alias("col"))


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_cells_of_any_polygon(spark, tile):
    rng = random.Random(tile)
    shapes = {k: [[(rng.randrange(-40, 140) / 4, rng.randrange(-40, 150) / 4) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 4))] for k in range(25)}
    shapes |= {100: [[(-5, -5), (20, -5), (20, 30), (-5, 30)], [(0, 0), (10, 0), (10, 10), (0, 10)]], 101: [[(2.5, 2.5), (2.5, 2.5), (2.5, 2.5)]], 102: [[(-100, 1.5), (500, 1.25), (500, 1.75)]], 103: [[(1, 1)]], 104: [[]]}
    want = {(k, y, x) for k, rings in shapes.items() for y in range(-6, 34) for x in range(-6, 24) if plain_inside(rings, x, y)}
    got = [(r.k, r.row, r.col) for r in P.covered(cells(spark), table_of(spark, shapes), ["k"], tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    clipped = [(r.row, r.col) for r in P.clip(cells(spark), table_of(spark, shapes), tile=tile).collect()]
    assert len(clipped) == len({(y, x) for _, y, x in want}) == len(set(clipped))


def test_tiles_without_an_edge_need_no_test(spark):
    big = {1: [[(0, 0), (1000, 0), (1000, 1000), (0, 1000)]], 2: [[(0, 0), (1000, 1000), (1000, 1010), (0, 10)]]}
    tiles = P.cover(table_of(spark, big), ["k"], tile=50)
    got = {r.k: (r.n, r.whole) for r in tiles.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("near").isNull().cast("int")).alias("whole")).collect()}
    assert got[1][1] == 19 * 19 and got[1][0] <= 21 * 21
    assert got[2][0] < 70  # along the slant, not its box of 441


def test_geojson_area_and_bounds(spark):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    texts = [json.dumps({"type": "Polygon", "coordinates": square}), json.dumps({"type": "MultiPolygon", "coordinates": [square, [[[10, 0], [12, 0], [12, 3]]]]}), '{"type": "Point", "coordinates": [1, 2]}', "no", None]
    rings = P.from_geojson(F.col("t"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", rings.alias("rings"))
    got = {r.k: (r.a, r.b and tuple(r.b)) for r in rows.select("k", P.area(F.col("rings")).alias("a"), P.bounds(F.col("rings")).alias("b")).collect()}
    assert got[0] == (15, (0, 0, 4, 4)) and got[1] == (18, (0, 0, 12, 4))
    assert [got[k][0] for k in (2, 3, 4)] == [None] * 3
    held = P.reduce_regions(cells(spark), rows, ["k"], {"n": F.count("row")})
    assert {r.k: r.n for r in held.collect()} == {0: 15, 1: 18, 2: None, 3: None, 4: None}


def test_names_and_nulls(spark):
    shapes = table_of(spark, {1: [[(0, 0), (3, 0), (3, 3), (0, 3)]], 2: [[(0, 0), (3, 0), (3, 3), (0, 3)]]}).withColumn("k", F.when(F.col("k") == 1, 1))
    two = shapes.union(table_of(spark, {1: [[(10, 10), (12, 10), (12, 12), (10, 12)]]}))
    got = {r.k: r.n for r in P.reduce_regions(cells(spark), two, ["k"], {"n": F.count("row")}).collect()}
    assert got == {1: 13, None: 9}
    with pytest.raises(ValueError):
        P.covered(cells(spark).withColumn("k", F.lit(1)), shapes, ["k"])
    assert P.clip(cells(spark), two.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "row long, col long")
    assert P.clip(lost, two).count() == 1
