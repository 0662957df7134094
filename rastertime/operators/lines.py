"""Kernels by lines: a neighbourhood in two window passes, along a row and then along a column.

The row pass partitions by a line of one image and gives each cell what its kernel needs of its own row, once for each
distinct kernel row. The column pass partitions by a column and takes those from the rows that the kernel reaches. Rows
are not repeated: two shuffles, whatever the kernel's size, against a copy for each of its cells. A partition is one line
of one image, and frames hold as many cells as the kernel is wide.

Where a line has gaps, empty cells are put in up to the kernel's width from the next valid one, as they carry what their row
holds to the cells above and below; a line without gaps gets some at its ends alone. They go before the result. A cell with several
rows in an image counts once, with its largest value.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl

Kernel = dict[tuple[int, int], float]


def _one_row_a_cell(df: DataFrame, band: str, keys: list[str], line: str, reach: int = 0) -> DataFrame:
    """(keys, row, col, band, _real) once a cell, and empty cells up to ``reach`` beside it along the line.

    Partitioned by line, so that the window over lines needs no further shuffle.
    """
    at = "col" if line == "row" else "row"
    rows = df.select(*keys, "row", "col", band).repartition(*keys, line)
    rows = rows.groupBy(*keys, "row", "col").agg(F.max(band).alias(band))
    if not reach:
        return rows.withColumn("_real", F.lit(True))
    over = Window.partitionBy(*keys, line).orderBy(at)
    far = F.lit(1 << 40)
    rows = rows.withColumns({"_before": F.coalesce(F.lag(at).over(over), F.col(at) - far), "_after": F.coalesce(F.lead(at).over(over), F.col(at) + far)})
    between = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    x = F.col(at).cast("long")
    empty = F.concat(between(F.greatest(F.col("_before") + reach + 1, x - reach), x - 1), between(x + 1, F.least(F.col("_after") - 1, x + reach)))
    cells = F.concat(F.array(F.struct(x.alias("x"), F.lit(True).alias("real"))), F.transform(empty, lambda e: F.struct(e.alias("x"), F.lit(False).alias("real"))))
    rows = rows.withColumn("_c", F.explode(cells))
    return rows.select(*keys, line, F.col("_c.x").alias(at), F.when(F.col("_c.real"), F.col(band)).alias(band), F.col("_c.real").alias("_real"))


def _along(keys: list[str], line: str, at: str, low: int, high: int):
    return Window.partitionBy(*keys, line).orderBy(at).rangeBetween(low, high)


def extreme(df: DataFrame, band: str, radius: float, largest: bool, keys: Iterable[str] = (), first: str = "row") -> DataFrame:
    """The largest or least value within a circle. ``first`` is the line of the first pass; circles are the same either way."""
    keys, r = list(keys), int(radius)
    other = "col" if first == "row" else "row"
    pick = F.max if largest else F.min
    half = {d: int((radius * radius - d * d) ** 0.5 + 1e-9) for d in range(-r, r + 1)}
    widths = sorted(set(half.values()))
    rows = _one_row_a_cell(df, band, keys, first, r)
    rows = rows.select("*", *[pick(band).over(_along(keys, first, other, -w, w)).alias(f"_w{w}") for w in widths])
    reached = [pick(f"_w{half[d]}").over(_along(keys, other, first, d, d)) for d in half]
    best = reached[0] if len(reached) == 1 else (F.greatest if largest else F.least)(*reached)
    return rows.select(*keys, "row", "col", best.alias(band), "_real").where("_real").drop("_real")


def contract_dilate(df: DataFrame, band: str, contract: float, dilate: float, keys: Iterable[str] = ()) -> DataFrame:
    """Largest within ``contract``, then least within ``dilate``; the second goes on along the lines that the first ended with."""
    wide = extreme(df, band, contract, True, keys, "row") if contract else df
    return extreme(wide, band, dilate, False, keys, "col" if contract else "row") if dilate else wide if contract else _one_row_a_cell(df, band, list(keys), "row").drop("_real")


def kernel(df: DataFrame, band: str, weights: Kernel, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, row, col, n, w, s, ss): valid cells under a kernel, their weights, weighted values and weighted squares, summed.

    A kernel row that is one run of equal weights is a running sum; any other takes its cells with their weights.
    """
    keys = list(keys)
    lines: dict[int, tuple] = {}
    for (dr, dc), v in sorted(weights.items()):
        lines[dr] = (*lines.get(dr, ()), (dc, float(v)))
    patterns = sorted(set(lines.values()))
    lefts, rights = min(dc for _, dc in weights), max(dc for _, dc in weights)
    rows = _one_row_a_cell(df, band, keys, "row", max(-lefts, rights, 0)).withColumn("_v", F.col(band).cast("double"))
    near = F.collect_list(F.struct(F.col("col").alias("c"), F.col("_v").alias("v"))).over(_along(keys, "row", "col", lefts, rights))
    runs = {p: p[-1][0] - p[0][0] + 1 == len(p) and len({v for _, v in p}) == 1 for p in patterns}
    over = lambda p: _along(keys, "row", "col", p[0][0], p[-1][0])
    made: list[Column] = [] if all(runs.values()) else [near.alias("_near")]
    for i, p in enumerate(patterns):
        if runs[p]:
            sums = (F.count("_v").over(over(p)), F.sum("_v").over(over(p)), F.sum(F.col("_v") * F.col("_v")).over(over(p)))
            made += [x.alias(f"_{n}{i}") for n, x in zip(("n", "s", "q"), sums)]
    rows = rows.select("*", *made)
    cols = {}
    for i, p in enumerate(patterns):
        one = p[0][1]
        if runs[p]:
            parts = (F.col(f"_n{i}"), F.col(f"_n{i}") * dbl(one), F.col(f"_s{i}") * dbl(one), F.col(f"_q{i}") * dbl(one))
        else:
            table = F.create_map(*[F.lit(x) for dc, v in p for x in (dc, v)])
            cells = F.filter("_near", lambda c: c["v"].isNotNull() & F.map_contains_key(table, (c["c"] - F.col("col")).cast("int")))
            weigh = lambda c: F.element_at(table, (c["c"] - F.col("col")).cast("int"))
            total = lambda f: F.aggregate(cells, dbl(0), lambda a, c: a + f(c))
            parts = (F.size(cells).cast("long"), total(weigh), total(lambda c: weigh(c) * c["v"]), total(lambda c: weigh(c) * c["v"] * c["v"]))
        cols |= {f"_{k}_{i}": x for k, x in zip("nwsq", parts)}
    rows = rows.select(*keys, "row", "col", "_real", *[x.alias(n) for n, x in cols.items()])
    at = {p: i for i, p in enumerate(patterns)}

    def down(k: str) -> Column:
        found = [F.sum(f"_{k}_{at[lines[d]]}").over(_along(keys, "col", "row", d, d)) for d in sorted(lines)]
        valid = [F.coalesce(x, F.lit(0).cast("long") if k == "n" else dbl(0)) for x in found]
        out = valid[0]
        for x in valid[1:]:
            out = out + x
        return out

    out = rows.select(*keys, "row", "col", "_real", *[down(k).alias(n) for k, n in (("n", "n"), ("w", "w"), ("s", "s"), ("q", "ss"))])
    return out.where("_real").drop("_real")


def statistics(df: DataFrame, band: str, weights: Kernel, keys: Iterable[str] = ()) -> DataFrame:
    """Adds to each cell n, sum, mean and variance (of the population) under a weighted kernel; NULL where no cell is valid."""
    found = kernel(df, band, weights, keys)
    mean = F.try_divide(F.col("s"), F.col("w"))
    variance = F.greatest(F.try_divide(F.col("ss"), F.col("w")) - mean * mean, dbl(0))
    return found.select(*keys, "row", "col", "n", F.when(F.col("n") > 0, F.col("s")).alias("sum"), mean.alias("mean"), variance.alias("variance"))


def window_of(df: DataFrame, band: str, radius: int, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, row, col, cells): for every cell an array of the valid cells (dr, dc, v) up to ``radius`` away in either direction."""
    keys = list(keys)
    rows = _one_row_a_cell(df, band, keys, "row", radius)
    near = F.collect_list(F.when(F.col(band).isNotNull(), F.struct(F.col("col").alias("c"), F.col(band).alias("v")))).over(_along(keys, "row", "col", -radius, radius))
    rows = rows.select(*keys, "row", "col", "_real", near.alias("_line"))
    lines = F.collect_list(F.struct(F.col("row").alias("r"), F.col("_line").alias("line"))).over(_along(keys, "col", "row", -radius, radius))
    rows = rows.select(*keys, "row", "col", "_real", lines.alias("_lines")).where("_real")
    cells = F.flatten(F.transform("_lines", lambda x: F.transform(x["line"], lambda y: F.struct((x["r"] - F.col("row")).alias("dr"), (y["c"] - F.col("col")).alias("dc"), y["v"].alias("v")))))
    return rows.select(*keys, "row", "col", cells.alias("cells"))
