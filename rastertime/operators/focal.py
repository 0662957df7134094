"""Neighbourhood operators on a grid of (row, col).

Extremes, weighted sums and whole windows go by lines (``operators.lines``), which repeats no row. Any other aggregate is
of small kernels: each cell sends its value to the cells that see it, and one aggregate by cell sums up: map-side partial
aggregation, a single shuffle, no self-join. Cells outside the grid are received by nobody and dropped.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl
from rastertime.operators import lines

#: Fixed value: the cells of the kernel of 41 x 41 for scan-line gaps, all of which must be valid.
FRINGE_LEAST = 279


def circle(radius: float) -> list[tuple[int, int]]:
    """Offsets within ``radius`` cells; below 1 only the cell itself."""
    r = int(radius)
    return [(dr, dc) for dr in range(-r, r + 1) for dc in range(-r, r + 1) if dr * dr + dc * dc <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    return [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1)]


def scatter(df: DataFrame, offsets: list[tuple[int, int]], keys: list[str] = ()) -> DataFrame:
    """Every row once per offset (dr, dc), at the cell that sees it there."""
    moves = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    rows = df.withColumn("_m", F.explode(moves))
    return rows.withColumns({"row": F.col("row") - F.col("_m.dr"), "col": F.col("col") - F.col("_m.dc"), "dr": F.col("_m.dr"), "dc": F.col("_m.dc")}).drop("_m")


def focal(df: DataFrame, exprs: dict[str, Column], offsets: list[tuple[int, int]], keys: list[str] = ()) -> DataFrame:
    """Aggregates over each cell's neighbourhood; the aggregates may use dr and dc."""
    here = F.max((F.col("dr") == 0) & (F.col("dc") == 0))
    offsets = offsets if (0, 0) in offsets else [*offsets, (0, 0)]
    out = scatter(df, offsets).groupBy(*keys, "row", "col").agg(here.alias("_here"), *[e.alias(n) for n, e in exprs.items()])
    return out.where("_here").drop("_here")


def focal_max(df: DataFrame, band: str, radius: float, keys: list[str] = ()) -> DataFrame:
    return lines.extreme(df, band, radius, True, keys)


def focal_min(df: DataFrame, band: str, radius: float, keys: list[str] = ()) -> DataFrame:
    return lines.extreme(df, band, radius, False, keys)


def focal_mean(df: DataFrame, band: str, radius: float, keys: list[str] = ()) -> DataFrame:
    return focal(df, {band: F.avg(band)}, circle(radius), keys)


def focal_mode(df: DataFrame, band: str, radius: float, keys: list[str] = ()) -> DataFrame:
    return focal(df, {band: F.mode(band, deterministic=True)}, circle(radius), keys)


def contract_dilate(df: DataFrame, band: str, contract: float, dilate: float, keys: list[str] = ()) -> DataFrame:
    """Clear cells first grow, then shrink: small masked specks go, larger ones get a margin."""
    return lines.contract_dilate(df, band, contract, dilate, keys)


def kernel_sum(df: DataFrame, band: str, weights: dict[tuple[int, int], float], name: str = "sum", keys: list[str] = ()) -> DataFrame:
    return lines.statistics(df, band, weights, keys).select(*keys, "row", "col", F.col("sum").alias(name))


def striped(half: int = 20, step: int = 2) -> dict[tuple[int, int], float]:
    """A square kernel of ones on every ``step``-th diagonal, which sees gaps that run across it."""
    return {(r, c): 1.0 for r in range(-half, half + 1) for c in range(-half, half + 1) if (r + c) % step == 0}


def slanting(half: int = 20, run: int = 9) -> dict[tuple[int, int], float]:
    """The kernel for scan-line gaps: runs of ones in groups of three rows, a row apart, that move left by one with each group."""
    out = {}
    for r in range(-half, half + 1):
        group, place = divmod(abs(r) + 2, 4)
        if place != 3:
            shift = (group if r < 0 else -group) - run // 2
            out |= {(r, shift + c): 1.0 for c in range(run)}
    return out


def defringe(df: DataFrame, bands: list[str], valid: str, least: float, weights: dict[tuple[int, int], float], keys: list[str] = ()) -> DataFrame:
    """Masks cells with fewer than ``least`` valid cells under the kernel. Only keys and ``valid`` are shuffled for it."""
    n = kernel_sum(df.select(*keys, "row", "col", F.col(valid).cast("double").alias("_v")), "_v", weights, "_n", keys)
    return df.join(n, [*keys, "row", "col"]).withColumns({b: F.when(F.col("_n") >= least, F.col(b)) for b in bands}).drop("_n")


def terrain(df: DataFrame, z: str = "z", cell: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """Slope and aspect in degrees by Horn's 3 x 3 differences; NULL at the edge."""
    dr, dc = F.col("dr"), F.col("dc")
    gx = F.sum(F.col(z) * dc * F.when(dr == 0, 2).otherwise(1)) / dbl(8 * cell)
    gy = F.sum(F.col(z) * dr * F.when(dc == 0, 2).otherwise(1)) / dbl(8 * cell)
    out = focal(df, {"_gx": gx, "_gy": gy, "_n": F.count(z), z: F.max(F.when((dr == 0) & (dc == 0), F.col(z)))}, square(1), keys)
    full = F.col("_n") == 9
    slope = F.when(full, F.degrees(F.atan(F.hypot("_gx", "_gy"))))
    aspect = F.degrees(F.atan2(-F.col("_gx"), F.col("_gy")))
    return out.withColumns({"slope": slope, "aspect": F.when(full, F.when(aspect < 0, aspect + dbl(360)).otherwise(aspect))}).drop("_gx", "_gy", "_n")


def illumination(zenith: Column, azimuth: Column) -> Column:
    """Cosine of the angle between sun and slope normal; angles in degrees."""
    z, s = F.radians(zenith), F.radians("slope")
    return F.cos(z) * F.cos(s) + F.sin(z) * F.sin(s) * F.cos(F.radians(azimuth) - F.radians("aspect"))


def illumination_correction(df: DataFrame, bands: list[str], image: str, zenith: Column) -> DataFrame:
    """C-correction: band regressed on illumination over sloped, lit ground per image; needs IC and slope."""
    fit = (F.col("slope") >= 5) & (F.col("IC") >= 0) & (F.col("nir") > dbl(-0.1))
    model = df.where(fit).groupBy(image).agg(*[e for b in bands for e in (F.regr_slope(b, "IC").alias(f"_s_{b}"), F.regr_intercept(b, "IC").alias(f"_o_{b}"))])
    level = F.cos(F.radians("slope")) * F.cos(F.radians(zenith))
    out = df.join(model, image, "left")

    def corrected(b: str) -> Column:
        c = F.try_divide(F.col(f"_o_{b}"), F.col(f"_s_{b}"))
        return F.coalesce(F.when(fit, F.col(b) * F.try_divide(level + c, F.col("IC") + c)), F.col(b))

    return out.withColumns({b: corrected(b) for b in bands}).drop(*[f"_{x}_{b}" for x in "so" for b in bands])


def project_shadows(clouds: DataFrame, dark: DataFrame, azimuth: float, zenith: float, heights: list[float], cell: float, contract: float = 1.5, dilate: float = 3.5) -> DataFrame:
    """Dark cells (row, col) on which any cloud cell throws its shadow from any height, as cells to mask."""
    from math import cos, radians, sin, tan

    az, reach = radians(azimuth) + pi, tan(radians(zenith))
    shifts = sorted({(round(h * reach * cos(az) / cell), round(h * reach * sin(az) / cell)) for h in heights})
    thrown = scatter(clouds.select("row", "col"), [(-a, -b) for a, b in shifts]).select("row", "col").distinct()
    found = dark.join(thrown.withColumn("_t", F.lit(1)), ["row", "col"], "left").withColumn("shadow", F.coalesce("_t", F.lit(0)) * F.col("dark")).drop("_t")
    return focal_max(focal_min(found.select("row", "col", "shadow"), "shadow", contract), "shadow", dilate)


def reduce_resolution(df: DataFrame, bands: list[str], factor: int, reducer=F.avg, keys: list[str] = ()) -> DataFrame:
    """Blocks of ``factor`` by ``factor`` cells."""
    return df.groupBy(*keys, F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(*[reducer(F.col(b)).alias(b) for b in bands], F.count(bands[0]).alias("n"))


def bilinear(df: DataFrame, points: DataFrame, band: str) -> DataFrame:
    """Values at fractional (y, x) from the four cells around, weighted; valid neighbours alone if some are masked."""
    near = points.withColumns({"row": F.explode(F.sequence(F.floor("y"), F.floor("y") + 1))}).withColumn("col", F.explode(F.sequence(F.floor("x"), F.floor("x") + 1)))
    w = (dbl(1) - F.abs(F.col("y") - F.col("row"))) * (dbl(1) - F.abs(F.col("x") - F.col("col")))
    met = near.withColumn("_w", w).join(df.select("row", "col", band), ["row", "col"]).where(F.col(band).isNotNull())
    return met.groupBy("y", "x").agg(F.try_divide(F.sum(F.col(band) * F.col("_w")), F.sum("_w")).alias(band))


def bicubic(df: DataFrame, points: DataFrame, band: str) -> DataFrame:
    """Values at fractional (y, x) by cubic convolution (a = -1/2) of the sixteen cells around; NULL unless all are valid."""

    def weight(d: Column) -> Column:
        near = (dbl(1.5) * d - dbl(2.5)) * d * d + dbl(1)
        far = ((dbl(-0.5) * d + dbl(2.5)) * d - dbl(4)) * d + dbl(2)
        return F.when(d <= 1, near).otherwise(far)

    near = points.withColumn("row", F.explode(F.sequence(F.floor("y") - 1, F.floor("y") + 2))).withColumn("col", F.explode(F.sequence(F.floor("x") - 1, F.floor("x") + 2)))
    near = near.withColumn("_w", weight(F.abs(F.col("y") - F.col("row"))) * weight(F.abs(F.col("x") - F.col("col"))))
    met = near.join(df.select("row", "col", band), ["row", "col"], "left")
    return met.groupBy("y", "x").agg(F.when(F.count(band) == 16, F.sum(F.col(band) * F.col("_w"))).alias(band))


def lee_filter(df: DataFrame, band: str, keys: list[str] = ()) -> DataFrame:
    """Refined Lee speckle filter: direction from 3 x 3 sample means in a 7 x 7 window, then a directional blend.

    Two passes along lines collect each cell's 49 neighbours as one array; all steps are array expressions.
    """
    at = {o: i for i, o in enumerate(square(3))}
    rows = lines.window_of(df, band, 3, keys)
    table = F.map_from_entries(F.transform("cells", lambda n: F.struct((n["dr"] * 7 + n["dc"]).cast("int").alias("k"), n["v"].alias("v"))))
    rows = rows.withColumn("_a", table)
    v = lambda r, c: F.try_element_at(F.col("_a"), F.lit(r * 7 + c))

    def stats(cells: list[tuple[int, int]]) -> tuple[Column, Column]:
        arr = F.filter(F.array(*[v(*c) for c in cells]), lambda x: x.isNotNull())
        n = F.size(arr).cast("double")
        mean = F.try_divide(F.aggregate(arr, dbl(0), lambda a, x: a + x), n)
        return mean, F.try_divide(F.aggregate(arr, dbl(0), lambda a, x: a + (x - mean) * (x - mean)), n)

    box = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    samples = {(i, j): stats([(2 * i + a, 2 * j + b) for a, b in box]) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    rows = rows.withColumns({f"_m{i}{j}": m for (i, j), (m, _) in samples.items()} | {f"_r{i}{j}": F.try_divide(s, m * m) for (i, j), (m, s) in samples.items()})
    noise = F.filter(F.array_sort(F.array(*[F.col(f"_r{i}{j}") for i, j in samples])), lambda x: x.isNotNull())
    noise = F.slice(noise, 1, 5)
    rows = rows.withColumn("_noise", F.try_divide(F.aggregate(noise, dbl(0), lambda a, x: a + x), F.size(noise).cast("double")))
    m = lambda i, j: F.coalesce(F.col(f"_m{i}{j}"), F.col("_m00"))
    ends = {0: ((0, -1), (0, 1)), 1: ((-1, 1), (1, -1)), 2: ((-1, 0), (1, 0)), 3: ((-1, -1), (1, 1))}
    steep = [F.abs(m(*p) - m(*q)) for p, q in ends.values()]
    rows = rows.withColumn("_g", F.array_position(F.array(*steep), F.array_max(F.array(*steep))).cast("int") - 1)
    nearer = lambda p, q: F.abs(m(*p) - m(0, 0)) < F.abs(m(*q) - m(0, 0))
    halves = {0: (lambda r, c: c <= 0, lambda r, c: c >= 0), 1: (lambda r, c: r <= c, lambda r, c: r >= c), 2: (lambda r, c: r <= 0, lambda r, c: r >= 0), 3: (lambda r, c: r + c <= 0, lambda r, c: r + c >= 0)}
    mean = var = None
    for g, (p, q) in ends.items():
        for take, test in ((nearer(p, q), halves[g][0]), (~nearer(p, q), halves[g][1])):
            dm, dv = stats([o for o in at if test(*o)])
            on = (F.col("_g") == g) & take
            mean = F.when(on, dm) if mean is None else mean.when(on, dm)
            var = F.when(on, dv) if var is None else var.when(on, dv)
    rows = rows.withColumns({"_mean": mean, "_var": var})
    signal = F.greatest((F.col("_var") - F.col("_mean") * F.col("_mean") * F.col("_noise")) / (F.col("_noise") + dbl(1)), dbl(0))
    blend = F.coalesce(F.try_divide(signal, F.col("_var")), dbl(0))
    return rows.select(*keys, "row", "col", (F.col("_mean") + blend * (v(0, 0) - F.col("_mean"))).alias(band))
