"""Shifts and displacement of images that are moved by known ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertime.operators import registration as G


def surface(spark, z, low=0):
    return spark.createDataFrame([(r + low, c + low, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "row long, col long, z double")


def moved(df, dr, dc, **more):
    return df.select(*[F.lit(v).alias(k) for k, v in more.items()], (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), (F.col("z") * 3 + 7).alias("z"))


def test_a_moved_image_comes_back(spark):
    z = np.random.default_rng(2).normal(size=(32, 32))
    ref = surface(spark, z)
    image = ref.select(F.lit("a").alias("image"), (F.col("row") + 2).alias("row"), (F.col("col") + 3).alias("col"), "z").where("row < 32 AND col < 32")
    got = {(x.row, x.col): x.z for x in G.co_registered(image, ref, "z", ["z"], tile=32, most=4, coarse=1).collect()}
    assert len(got) == 30 * 29
    assert all(v == (z[r, c] if r < 30 and c < 29 else None) for (r, c), v in got.items())
    still = G.displaced(image, G.shifts(image, ref, "z", tile=32, most=4, coarse=1), ["z"], tile=32, most=2)
    assert still.exceptAll(image).isEmpty()


@pytest.mark.parametrize("coarse", [1, 4])
def test_shifts_of_tiles_on_either_side_of_zero(spark, coarse):
    rng = np.random.default_rng(5)
    z = np.kron(rng.normal(size=(24, 24)), np.ones((2, 2))) + rng.normal(0, 0.2, (48, 48))
    ref = surface(spark, z, -24)
    images = moved(ref, 5, -6, image=1).union(moved(ref, -8, 0, image=2)).union(moved(ref, 0, 0, image=3).withColumn("z", F.when(F.col("row") % 5 > 0, F.col("z"))))
    got = {}
    for r in G.shifts(images, ref, "z", tile=24, most=8, coarse=coarse).collect():
        got.setdefault(r.image, set()).add((r.dr, r.dc, round(r.r, 6)))
    assert got == {1: {(5, -6, 1.0)}, 2: {(-8, 0, 1.0)}, 3: {(0, 0, 1.0)}}


def test_tiles_hold_every_cell_near_them(spark):
    z = np.arange(60.0).reshape(6, 10)
    got = {(r.tile_row, r.tile_col): r.lines for r in G.tiles(surface(spark, z, -2), "z", 4, 1).collect()}
    padded = {(r - 2, c - 2): z[r, c] for r in range(6) for c in range(10)}
    assert set(got) == {(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1, 2)}
    for (a, b), lines in got.items():
        for i in range(6):
            line = lines[i]
            for j in range(6):
                assert (line[j] if line else None) == padded.get((a * 4 - 1 + i, b * 4 - 1 + j))


def test_flat_and_thin_overlaps_give_no_shift(spark):
    ref = surface(spark, np.ones((8, 8)))
    assert G.shifts(moved(ref, 1, 1, image=1), ref, "z", tile=8, most=2, coarse=1).count() == 0
    z = surface(spark, np.random.default_rng(1).normal(size=(8, 8)))
    thin = moved(z, 0, 0, image=1).where("col < 3")
    assert G.shifts(thin, z, "z", tile=8, most=2, coarse=1).count() == 0
    assert G.co_registered(thin, z, "z", ["z"], tile=8, most=2, coarse=1).exceptAll(thin).isEmpty()


@pytest.mark.parametrize("group", ["number", "name"])
def test_groups_have_their_own_first_image(spark, group):
    rng = np.random.default_rng(7)
    a, b = surface(spark, rng.normal(size=(20, 20))), surface(spark, rng.normal(size=(20, 20)))
    rows = moved(a, 0, 0, image=1, t=5, number=10).union(moved(a, 2, 1, image=2, t=9, number=10)).union(moved(b, 0, 0, image=3, t=2, number=20)).union(moved(b, -1, -2, image=4, t=3, number=20)).union(moved(b, 3, 0, image=5, t=4, number=20)).union(moved(b, 0, 0, image=6, t=1, number=None))
    rows = rows.withColumn("name", F.concat(F.lit("path "), "number"))
    out = G.co_registered_groups(rows, "z", ["z"], group, "t", tile=20, most=3, coarse=1)
    got = {}
    for r in out.collect():
        got.setdefault(r.image, {})[r.row, r.col] = r.z
    assert set(got) == {1, 2, 3, 4, 5}
    for image, first in ((2, 1), (4, 3), (5, 3)):
        inner = {x: got[image][x] for x in got[image] if 4 <= x[0] < 16 and 4 <= x[1] < 16}
        assert len(inner) == 144 and all(v == got[first][x] for x, v in inner.items())


def test_fields_between_tiles(spark):
    """On a plane, a field of one fractional shift moves values by the slope times the shift; tiles without a shift stay."""
    cells = spark.createDataFrame([(1, r, c, 2.0 * r - 5.0 * c) for r in range(16) for c in range(16)], "image int, row long, col long, z double")
    offsets = spark.createDataFrame([(1, r, c, 0.5, -1.25) for r in range(4) for c in range(4)], "image int, tile_row long, tile_col long, dr double, dc double")
    out = {(r.row, r.col): r.z for r in G.displaced_by_field(cells, offsets, ["z"], tile=4, rounds=2).collect()}
    assert len(out) == 256
    assert all(out[r, c] == pytest.approx(2 * (r + 0.5) - 5 * (c - 1.25)) for r in range(1, 14) for c in range(3, 15))
    ramp = offsets.withColumns({"dr": F.lit(0.0), "dc": F.col("tile_col").cast("double")})
    found = {(r.row, r.col): (r.dy, r.dx) for r in G.field(cells, ramp, tile=4).collect()}
    assert found[0, 2] == (0, pytest.approx(0.125)) and found[5, 5] == (0, pytest.approx(0.875)) and found[3, 0] == (0, 0) and found[9, 15] == (0, 3)
    none = G.displaced_by_field(cells, offsets.limit(0), ["z"], tile=4)
    assert none.select(*cells.columns).exceptAll(cells).isEmpty()
