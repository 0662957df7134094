"""From grid to grid: an affine transform per grid, target cells that find their source cells by an equi-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl
from rastertime.operators.focal import bilinear


@dataclass(frozen=True)
class Grid:
    """A cell's middle lies at x = x0 + col * xc + row * xr, y = y0 + col * yc + row * yr."""

    x0: float = 0.0
    y0: float = 0.0
    xc: float = 1.0
    xr: float = 0.0
    yc: float = 0.0
    yr: float = 1.0

    def place(self, row: Column, col: Column) -> tuple[Column, Column]:
        """(x, y) of a cell."""
        return dbl(self.x0) + col * dbl(self.xc) + row * dbl(self.xr), dbl(self.y0) + col * dbl(self.yc) + row * dbl(self.yr)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col), as fractions, of a place."""
        size = self.xc * self.yr - self.xr * self.yc
        if not size:
            raise ValueError("the rows and columns of a grid can't have one direction")
        u, v = x - dbl(self.x0), y - dbl(self.y0)
        return (v * dbl(self.xc) - u * dbl(self.yc)) / dbl(size), (u * dbl(self.yr) - v * dbl(self.xr)) / dbl(size)

    def translated(self, dx: float, dy: float) -> Grid:
        return Grid(self.x0 + dx, self.y0 + dy, self.xc, self.xr, self.yc, self.yr)


def _nearest(c: Column) -> Column:
    """The whole number at most half below; sums of fractions are rounded to nine digits first, so that borders are exact."""
    return F.floor(F.round(c, 9) + dbl(0.5)).cast("long")


def target_cells(df: DataFrame, source: Grid, target: Grid, tile: int = 64) -> DataFrame:
    """(row, col) of the target cells whose middles may lie in a source cell: from the corners of the source's tiles, each once."""
    tiles = df.select(F.floor(F.col("row") / tile).alias("r"), F.floor(F.col("col") / tile).alias("c")).distinct()
    corners = []
    for i in (0, 1):
        for j in (0, 1):
            x, y = source.place((F.col("r") + i) * tile - dbl(0.5), (F.col("c") + j) * tile - dbl(0.5))
            corners.append(target.cell(x, y))
    span = lambda k: F.explode(F.sequence(F.floor(F.least(*[c[k] for c in corners])).cast("long"), F.ceil(F.greatest(*[c[k] for c in corners])).cast("long")))
    return tiles.withColumn("row", span(0)).select("*", span(1).alias("col")).select("row", "col").distinct()


def reproject(df: DataFrame, bands: list[str], source: Grid, target: Grid, method: str = "nearest", cells: DataFrame | None = None) -> DataFrame:
    """(row, col, bands) on the target grid, for target cells that find a valid source cell.

    nearest: the source cell that holds the target cell's middle. bilinear: the four around it, weighted. mean: all source
    cells whose middles the target cell holds, which suits coarser targets and needs one aggregate. ``cells`` (row, col) limits
    the target, else it covers the source. One image; join keys of many images to ``cells`` and bands beforehand.
    """
    if method == "mean":
        x, y = source.place(F.col("row"), F.col("col"))
        row, col = target.cell(x, y)
        out = df.select(_nearest(row).alias("row"), _nearest(col).alias("col"), *bands).groupBy("row", "col").agg(*[F.avg(b).alias(b) for b in bands])
        return out if cells is None else out.join(cells, ["row", "col"], "left_semi")
    wanted = target_cells(df, source, target) if cells is None else cells.select("row", "col")
    x, y = target.place(F.col("row"), F.col("col"))
    row, col = source.cell(x, y)
    if method == "nearest":
        at = wanted.select("row", "col", _nearest(row).alias("_row"), _nearest(col).alias("_col"))
        return at.join(df.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *bands), ["_row", "_col"]).select("row", "col", *bands)
    if method != "bilinear":
        raise ValueError(f"no method {method!r}; known: nearest, bilinear, mean")
    points = wanted.select("row", "col", F.round(row, 9).alias("y"), F.round(col, 9).alias("x"))
    out = points
    for b in bands:
        out = out.join(bilinear(df, points.select("y", "x").distinct(), b), ["y", "x"])
    return out.select("row", "col", *bands)
