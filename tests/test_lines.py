"""Kernels by lines against loops over every neighbour."""

import random

import pytest
from pyspark.sql import functions as F

from rastertime.operators import focal as L
from rastertime.operators import lines


def scattered(spark, seed=0, n=200):
    rng = random.Random(seed)
    cells = {(k, r, c): rng.choice([None, *range(-9, 10)]) for k in ("a", "b") for r in range(-4, 9) for c in range(-3, 10) if rng.random() < 0.7}
    rows = [(k, r, c, None if v is None else float(v)) for (k, r, c), v in cells.items()]
    return cells, spark.createDataFrame(rows, "k string, row long, col long, v double")


@pytest.mark.parametrize("radius", [0, 1, 1.5, 2, 2.9, 3.5])
def test_extremes_in_circles(spark, radius):
    cells, df = scattered(spark, 1)
    for largest, first in ((True, "row"), (False, "col")):
        got = {(r.k, r.row, r.col): r.v for r in lines.extreme(df, "v", radius, largest, ["k"], first).collect()}
        assert set(got) == set(cells)
        for (k, r, c), v in got.items():
            near = [cells.get((k, r + a, c + b)) for a, b in L.circle(radius)]
            near = [x for x in near if x is not None]
            assert v == ((max if largest else min)(near) if near else None)


def test_contract_then_dilate(spark):
    cells, df = scattered(spark, 2)
    for contract, dilate in ((1.5, 2.5), (0, 1), (2, 0), (0, 0)):
        both = lines.extreme(lines.extreme(df, "v", contract, True, ["k"]), "v", dilate, False, ["k"])
        assert sorted(map(repr, lines.contract_dilate(df, "v", contract, dilate, ["k"]).select("k", "row", "col", "v").collect())) == sorted(map(repr, both.select("k", "row", "col", "v").collect()))


@pytest.mark.parametrize("weights", [L.striped(3), L.slanting(), {(0, 0): 2.0, (0, 2): -1.0, (-1, 1): 0.5, (3, -2): 4.0}, {(a, b): 1.0 for a in (-1, 0, 1) for b in (-1, 0, 1)}], ids=["striped", "slanting", "odd", "box"])
def test_weighted_sums(spark, weights):
    cells, df = scattered(spark, 3)
    got = {(r.k, r.row, r.col): r for r in lines.statistics(df, "v", weights, ["k"]).collect()}
    assert set(got) == set(cells)
    for (k, r, c), x in got.items():
        near = [(w, cells.get((k, r + a, c + b))) for (a, b), w in weights.items()]
        near = [(w, v) for w, v in near if v is not None]
        assert x.n == len(near)
        if near:
            s, w = sum(w * v for w, v in near), sum(w for w, _ in near)
            assert x.sum == pytest.approx(s)
            if abs(w) > 1e-9:
                assert x.mean == pytest.approx(s / w) and x.variance == pytest.approx(max(0, sum(w * v * v for w, v in near) / w - (s / w) ** 2), abs=1e-9)
        else:
            assert x.sum is None and x["mean"] is None


def test_the_slanting_kernel():
    k = L.slanting()
    assert len(k) == L.FRINGE_LEAST and max(abs(a) for p in k for a in p) == 20
    assert all((-a, -b) in k for a, b in k) and (0, 4) in k and (1, 0) not in k and (-20, 1) in k and (-20, 9) in k and (-20, 10) not in k


def test_windows_of_cells_and_repeated_rows(spark):
    cells, df = scattered(spark, 4)
    twice = df.union(df.where("v > 0").withColumn("v", F.col("v") - 1))
    got = {(r.k, r.row, r.col): {(x.dr, x.dc): x.v for x in r.cells} for r in lines.window_of(twice, "v", 2, ["k"]).collect()}
    for (k, r, c), near in got.items():
        assert near == {(a, b): cells[k, r + a, c + b] for a in range(-2, 3) for b in range(-2, 3) if cells.get((k, r + a, c + b)) is not None}


def test_rows_are_hardly_repeated(spark):
    _, df = scattered(spark, 5)
    plan = lines.contract_dilate(df, "v", 1.5, 3.5, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    full = spark.range(100 * 100).selectExpr("'a' AS k", "id div 100 AS row", "id % 100 AS col", "1D AS v")
    assert lines._one_row_a_cell(full, "v", ["k"], "row", 20).count() == 100 * 140
    assert lines._one_row_a_cell(full, "v", ["k"], "col", 3).count() == 100 * 106
