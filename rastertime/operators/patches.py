"""Patches of connected cells of equal value, by runs.

A pass along rows makes runs: cells beside one another of one value, named by their first cell. A pass along columns
finds the runs that touch from row to row, and only these edges between runs, each once, are contracted to components. So
the rounds work on runs, of which there are far fewer than cells, and cells get their patch by a join on their own run,
which a row of the image bounds, never on a patch that may hold most cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertime.operators.graph import components
from rastertime.operators.lines import _one_row_a_cell
from rastertime.sources.scratch import materialise, release, settled

WIDTH = 1 << 31


def _cells(df: DataFrame, value: str, keys: list[str], eight: bool) -> DataFrame:
    """(keys, row, col, value, id, run, left, right): the run of each cell and those of the cells beside it."""
    one_image = F.col("row").cast("long") * F.lit(WIDTH) + F.col("col")
    rows = df.select(*keys, "row", "col", value)
    rows = rows.withColumn("id", one_image) if not keys else materialise(rows.withColumn("id", F.monotonically_increasing_id()))
    rows = _one_row_a_cell(rows.select(*keys, "row", "col", F.struct(F.col(value).alias("v"), "id").alias("_b")), "_b", keys, "row", 1 if eight else 0)
    line = Window.partitionBy(*keys, "row").orderBy("col")
    v = F.col("_b.v")
    beside = F.lag("col").over(line) == F.col("col") - 1
    begins = v.isNotNull() & ~F.coalesce(beside & (F.lag(v).over(line) == v), F.lit(False))
    rows = rows.withColumn("run", F.when(begins, F.col("_b.id")))
    rows = rows.withColumn("run", F.when(v.isNotNull(), F.last("run", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))))
    cell = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("run").alias("run")))
    next_to = lambda f, step: F.when(f("col").over(line) == F.col("col") + step, f(cell).over(line))
    return rows.select(*keys, "row", "col", "_real", v.alias(value), "run", cell.alias("_own"), *([next_to(F.lag, -1).alias("_left"), next_to(F.lead, 1).alias("_right")] if eight else []))


def _edges(cells: DataFrame, keys: list[str], eight: bool) -> DataFrame:
    """(a, b): runs of equal value that touch from one row to the next."""
    column = Window.partitionBy(*keys, "col").orderBy("row")
    above = lambda c: F.when(F.lag("row").over(column) == F.col("row") - 1, F.lag(c).over(column))
    seen = [above(c) for c in (("_own", "_left", "_right") if eight else ("_own",))]
    met = cells.select("_own", F.array(*seen).alias("_seen")).where(F.col("_own").isNotNull())
    met = met.select(F.col("_own.run").alias("a"), F.explode(F.filter("_seen", lambda s: s["v"] == F.col("_own.v"))).alias("s"))
    return met.select("a", F.col("s.run").alias("b")).distinct()


def _labelled(df: DataFrame, value: str, eight: bool, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, row, col, value, run) once a cell, and (run, patch, cells) of every run; both tables."""
    cells = materialise(_cells(df, value, keys, eight))
    edges = materialise(_edges(cells, keys, eight))
    found = components(edges)
    runs = cells.where("run IS NOT NULL").groupBy("run").agg(F.count(F.lit(1)).alias("cells"))
    runs = materialise(runs.join(found.withColumnRenamed("id", "run"), "run", "left").select("run", F.coalesce("component", "run").alias("patch"), "cells"))
    release(edges, found)
    return cells.where("_real").select(*keys, "row", "col", value, "run"), runs


def patches(df: DataFrame, value: str, eight: bool = False, keys: list[str] = ()) -> DataFrame:
    """(keys, row, col, value, patch) once a cell; patch is the least cell id of the connected cells of equal value.

    Cells with a NULL value are in no patch, and connect none. Of several rows of a cell that of the largest value counts.
    ``eight``: corners connect too. Without keys, ids are row * 2^31 + col; with keys, numbers of cells over all images.
    """
    def make() -> DataFrame:
        cells, runs = _labelled(df, value, eight, list(keys))
        return cells.join(runs.drop("cells"), "run", "left").drop("run")

    return settled(make)


def patch_sizes(df: DataFrame, value: str, eight: bool = False, most: int | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, row, col, value, n) once a cell: the cells in its patch, counted up to ``most``; NULL where the value is."""

    def make() -> DataFrame:
        cells, runs = _labelled(df, value, eight, list(keys))
        n = F.sum("cells")
        sizes = runs.groupBy("patch").agg((F.least(n, F.lit(most)) if most else n).alias("n"))
        of = runs.join(sizes, "patch").select("run", "n")
        return cells.join(of, "run", "left").drop("run")

    return settled(make)


def at_least(df: DataFrame, value: str, bands: list[str], mmu: int, eight: bool = True, keys: list[str] = ()) -> DataFrame:
    """Masks ``bands`` of cells whose patch of equal ``value`` has fewer than ``mmu`` cells, or which have no value."""
    if mmu <= 1:
        return df
    sized = patch_sizes(df, value, eight, mmu, keys).where(F.col("n") >= mmu).select(*keys, "row", "col", F.lit(True).alias("_stays"))
    out = df.join(sized, [*keys, "row", "col"], "left")
    return out.select(*[F.when(F.col("_stays"), F.col(c)).alias(c) if c in bands else F.col(c) for c in df.columns])


def disturbances_at_least(df: DataFrame, mmu: int, n: int = 3, keys: list[str] = (), fields: tuple[str, ...] = ("yod", "mag", "dur", "preval")) -> DataFrame:
    """Wide disturbances of cells (``functions.segments.disturbances``), each slot without patches of one year under ``mmu`` cells."""
    for i in range(1, n + 1):
        df = at_least(df, f"yod_{i}", [f"{f}_{i}" for f in fields], mmu, True, keys)
    return df


def stand_age_at_least(df: DataFrame, age: str, mmu: int, keys: list[str] = (), name: str = "mmu_age") -> DataFrame:
    """Adds the age of stands whose forest, cells with any age, is connected over ``mmu`` cells at least; NULL elsewhere."""
    forest = df.withColumns({"_forest": F.when(F.col(age).isNotNull(), F.lit(1)), name: F.col(age)})
    return at_least(forest, "_forest", [name], mmu, True, keys).drop("_forest")


def sieve(df: DataFrame, value: str, mmu: int = 4, keys: list[str] = ()) -> DataFrame:
    """Cells of patches of ``mmu`` cells or fewer take the commonest value within mmu / 2 cells; masked cells stay masked."""
    from rastertime.operators.focal import focal_mode

    sized = patch_sizes(df, value, True, mmu + 20, keys)
    mode = focal_mode(df.select(*keys, "row", "col", value), value, mmu / 2, list(keys)).withColumnRenamed(value, "_mode")
    chosen: Column = F.when(F.col("n") <= mmu, F.col("_mode")).otherwise(F.col(value))
    return sized.join(mode, [*keys, "row", "col"]).select(*keys, "row", "col", chosen.alias(value))
