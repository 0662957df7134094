"""Patches against flood filling."""

import random

import pytest
from pyspark.sql import functions as F

from rastertime.operators import patches
from rastertime.operators.graph import components


def flood(cells, eight):
    """cell -> the cells of its patch."""
    out = {}
    for start in cells:
        if start in out or cells[start] is None:
            continue
        todo, seen = [start], {start}
        while todo:
            k, r, c = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    x = (k, r + dr, c + dc)
                    if (eight or not (dr and dc)) and x not in seen and cells.get(x) == cells[start] and cells.get(x) is not None:
                        seen.add(x)
                        todo.append(x)
        for x in seen:
            out[x] = seen
    return out


def scattered(spark, seed, share=0.8):
    rng = random.Random(seed)
    cells = {(k, r, c): rng.choice([1, 1, 2, None]) for k in ("a", "b") for r in range(-3, 12) for c in range(-2, 11) if rng.random() < share}
    return cells, spark.createDataFrame([(*x, v) for x, v in cells.items()], "k string, row long, col long, v int")


@pytest.mark.parametrize("eight", [False, True])
def test_patches_of_several_images(spark, eight):
    cells, df = scattered(spark, int(eight))
    want = flood(cells, eight)
    rows = patches.patches(df, "v", eight, ["k"]).collect()
    assert len(rows) == len(cells)
    by = {}
    for r in rows:
        by.setdefault(r.patch, set()).add((r.k, r.row, r.col))
    assert {frozenset(x) for p, x in by.items() if p is not None} == {frozenset(x) for x in want.values()}
    assert by.get(None, set()) == {x for x, v in cells.items() if v is None}
    sizes = {(r.k, r.row, r.col): r.n for r in patches.patch_sizes(df, "v", eight, 6, ["k"]).collect()}
    assert sizes == {x: min(6, len(want[x])) if x in want else None for x in cells}


def test_names_are_least_cells(spark):
    cells, df = scattered(spark, 7)
    one = {x: v for x, v in cells.items() if x[0] == "a" and x[2] >= 0}
    got = {(r.row, r.col): r.patch for r in patches.patches(df.where("k = 'a' AND col >= 0"), "v").collect()}
    want = flood(one, False)
    assert got == {x[1:]: min(r * patches.WIDTH + c for _, r, c in want[x]) if x in want else None for x in one}


def test_masks_under_a_minimum(spark):
    cells, df = scattered(spark, 9)
    want = flood(cells, True)
    rows = df.withColumns({"x": F.col("row") * 2, "y": F.lit("kept")})
    got = {(r.k, r.row, r.col): (r.v, r.x, r.y) for r in patches.at_least(rows, "v", ["x"], 4, keys=["k"]).collect()}
    assert got == {x: (v, x[1] * 2 if x in want and len(want[x]) >= 4 else None, "kept") for x, v in cells.items()}
    assert patches.at_least(rows, "v", ["x"], 1) is rows


def test_sieve_at_its_exact_size(spark):
    a = {(r, c): 0 for r in range(9) for c in range(12)}
    a |= {x: 1 for x in [(1, 1), (2, 2), (1, 3), (2, 4)]}  # four, over corners: goes
    a |= {x: 2 for x in [(6, 1), (6, 2), (6, 3), (6, 4), (6, 5)]}  # five: stays
    a[4, 9] = None
    df = spark.createDataFrame([(r, c, v) for (r, c), v in a.items()], "row long, col long, v int")
    got = {(r.row, r.col): r.v for r in patches.sieve(df, "v", 4).collect()}
    assert got == {x: 0 if v == 1 else v for x, v in a.items()}


def test_a_long_chain_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 600, 601: 600}
    assert components(edges.limit(0)).count() == 0
