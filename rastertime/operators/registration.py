"""Registration of images: search of shifts by correlation, per tile and group, and displacement by them.

A shift (dr, dc) says that an image has at (row + dr, col + dc) what the reference has at (row, col). Images become tiles
with a halo as wide as the largest shift, arrays of lines that each cell reaches at most four of, and meet the reference's
tiles one to one. Every candidate shift of a pair of tiles is one row, whose sums of products are one aggregate over
both arrays; the best is a maximum that sums up before the shuffle. Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl
from rastertime.operators import lines
from rastertime.operators.focal import reduce_resolution

TILE = ["tile_row", "tile_col"]


def _dense(found: str, n: int, value: str) -> Column:
    """An array of n places from an array of (k, value): the largest of each place, NULL where there is none."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_max(F.transform(F.filter(found, lambda e: e["k"] == i), lambda e: e[value])))


def tiles(df: DataFrame, band: str, tile: int, halo: int = 0, keys: list[str] = ()) -> DataFrame:
    """(keys, tile_row, tile_col, lines): each tile's lines of values, with ``halo`` more cells on every side."""
    n = tile + 2 * halo
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    place = lambda c, t: (F.col(c) - F.col(t) * tile + halo).cast("int").alias("k")
    rows = df.select(*keys, "row", "col", F.col(band).cast("double").alias("v")).withColumn("tile_col", reach("col"))
    rows = rows.groupBy(*keys, "row", "tile_col").agg(F.collect_list(F.struct(place("col", "tile_col"), "v")).alias("_c"))
    rows = rows.select(*keys, "row", "tile_col", _dense("_c", n, "v").alias("v")).withColumn("tile_row", reach("row"))
    rows = rows.groupBy(*keys, *TILE).agg(F.collect_list(F.struct(place("row", "tile_row"), "v")).alias("_c"))
    return rows.select(*keys, *TILE, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.transform(F.filter("_c", lambda e: e["k"] == i), lambda e: e["v"]), F.lit(0))).alias("lines"))


def _correlation(a: Column, b: Column, dr: Column, dc: Column, tile: int, halo: int) -> Column:
    """(n, r) of a tile's lines with another's, shifted: valid pairs and their correlation, NULL without variance."""
    line = lambda x, y: F.coalesce(F.zip_with(x, F.slice(y, dc + (halo + 1), F.lit(tile)), lambda p, q: F.when(p.isNotNull() & q.isNotNull(), F.struct(p.alias("p"), q.alias("q")))), F.array())
    pairs = F.filter(F.flatten(F.zip_with(a, F.slice(b, dr + (halo + 1), F.lit(tile)), line)), lambda e: e.isNotNull())
    zero = F.struct(*[dbl(0).alias(c) for c in ("n", "p", "q", "pp", "qq", "pq")])
    add = lambda s, e: F.struct((s["n"] + 1).alias("n"), (s["p"] + e["p"]).alias("p"), (s["q"] + e["q"]).alias("q"), (s["pp"] + e["p"] * e["p"]).alias("pp"), (s["qq"] + e["q"] * e["q"]).alias("qq"), (s["pq"] + e["p"] * e["q"]).alias("pq"))
    return F.aggregate(pairs, zero, add)


def shifts(images: DataFrame, reference: DataFrame, band: str, image: str = "image", tile: int = 64, most: int = 20, coarse: int = 4, on: list[str] = ()) -> DataFrame:
    """(on, image, tile_row, tile_col, dr, dc, r): the shift of each tile that correlates best, up to ``most`` cells either way.

    ``on``: columns that images and reference share, as each group has a reference of its own. Shifts under which fewer than
    half of the reference's valid cells meet a valid one don't count; of equal correlations (to nine digits) the nearest
    shift counts. A tile without any is left out. With ``coarse`` over 1 the search goes first over means of blocks of so many
    cells, then around the best one, as a pyramid does; with 1 it tries every shift.
    """
    near = None
    if coarse > 1 and tile % coarse == 0 and most >= 2 * coarse:
        less = lambda df, keys: reduce_resolution(df, [band], coarse, keys=keys).drop("n")
        near = shifts(less(images, [*on, image]), less(reference, list(on)), band, image, tile // coarse, -(-most // coarse), 1, on).select(*on, image, *TILE, "dr", "dc")
    halo = most
    mine = tiles(images, band, tile, halo, [*on, image]).withColumnRenamed("lines", "_b")
    met = mine.join(tiles(reference, band, tile, 0, list(on)).withColumnRenamed("lines", "_a"), [*on, *TILE])
    if near is None:
        span = {c: F.sequence(F.lit(-most), F.lit(most)) for c in ("_dr", "_dc")}
    else:
        met = met.join(near, [*on, image, *TILE], "left")
        middle = lambda c: F.coalesce(F.col(c) * coarse, F.lit(0)).cast("int")
        span = {f"_{c}": F.sequence(F.greatest(middle(c) - coarse, F.lit(-most)), F.least(middle(c) + coarse, F.lit(most))) for c in ("dr", "dc")}
        met = met.withColumns({f"_s{c}": e for c, e in span.items()}).drop("dr", "dc")
        span = {c: F.col(f"_s{c}") for c in span}
    valid = F.aggregate("_a", F.lit(0), lambda n, x: n + F.coalesce(F.size(F.filter(x, lambda v: v.isNotNull())), F.lit(0)))
    tried = met.withColumn("_valid", valid).withColumn("_dr", F.explode(span["_dr"])).withColumn("_dc", F.explode(span["_dc"]))
    tried = tried.select(*on, image, *TILE, "_valid", "_dr", "_dc", _correlation(F.col("_a"), F.col("_b"), F.col("_dr"), F.col("_dc"), tile, halo).alias("_s"))
    s = lambda c: F.col(f"_s.{c}")
    spread = (s("n") * s("pp") - s("p") * s("p")) * (s("n") * s("qq") - s("q") * s("q"))
    r = F.when(spread > 0, (s("n") * s("pq") - s("p") * s("q")) / F.sqrt(spread))
    tried = tried.withColumn("_r", r).where(F.col("_r").isNotNull() & (s("n") * 2 >= F.col("_valid")))
    order = F.struct(F.round("_r", 9), -(F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc")), -F.col("_dr"), -F.col("_dc"))
    best = tried.groupBy(*on, image, *TILE).agg(F.max_by(F.struct(F.col("_dr").alias("dr"), F.col("_dc").alias("dc"), F.col("_r").alias("r")), order).alias("_best"))
    return best.select(*on, image, *TILE, *[F.col(f"_best.{c}").alias(c) for c in ("dr", "dc", "r")])


def displaced(images: DataFrame, offsets: DataFrame, bands: list[str], image: str = "image", tile: int = 64, most: int = 20) -> DataFrame:
    """(image, row, col, bands): each cell takes the values at its place plus its tile's offset, NULL where no cell is.

    ``offsets`` as from ``shifts``, a row per image and tile. A tile without one, or whose offset passes ``most`` cells
    either way, stays in place. Cells are joined by tile, then by place; nothing is collected.
    """
    here = {"tile_row": F.floor(F.col("row") / tile), "tile_col": F.floor(F.col("col") / tile)}
    near = offsets.where((F.abs("dr") <= most) & (F.abs("dc") <= most)).select(image, *TILE, "dr", "dc")
    at = images.select(image, "row", "col").withColumns(here).join(near, [image, *TILE], "left")
    at = at.select(image, "row", "col", *[(F.col(c) + F.coalesce(d, F.lit(0))).alias(f"_{c}") for c, d in (("row", "dr"), ("col", "dc"))])
    source = images.select(image, F.col("row").alias("_row"), F.col("col").alias("_col"), *bands)
    return at.join(source, [image, "_row", "_col"], "left").drop("_row", "_col")


def smoothed(offsets: DataFrame, image: str = "image", rounds: int = 1) -> DataFrame:
    """Shifts of tiles as doubles, each the mean of its own and its neighbours' after each round; more rounds, a stiffer field."""
    out = offsets.select(image, F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), F.col("dr").cast("double").alias("dr"), F.col("dc").cast("double").alias("dc"))
    box = {(a, b): 1.0 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    for _ in range(rounds):
        mean = lambda c: lines.statistics(out, c, box, [image]).select(image, "row", "col", F.col("mean").alias(c))  # noqa: B023, E731
        out = mean("dr").join(mean("dc"), [image, "row", "col"])
    return out.withColumnsRenamed({"row": "tile_row", "col": "tile_col"})


def field(cells: DataFrame, offsets: DataFrame, image: str = "image", tile: int = 64) -> DataFrame:
    """Adds dy and dx to every cell: its tiles' shifts, interpolated bilinearly between the middles of tiles.

    Tiles bring their neighbours' shifts with them, so a cell joins one row. Where some of the four tiles around it have no
    shift, the others count; where none has one, the cell stays in place.
    """
    pair = offsets.select(image, F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), F.struct(F.col("dr").cast("double").alias("dr"), F.col("dc").cast("double").alias("dc")).alias("_d"))
    known = cells.select(image, F.floor(F.col("row") / tile).alias("row"), F.floor(F.col("col") / tile).alias("col")).distinct().withColumn("_d", F.lit(None).cast(pair.schema["_d"].dataType))
    near = lines.window_of(known.unionByName(pair), "_d", 1, [image])
    near = near.select(image, F.col("row").alias("_tr"), F.col("col").alias("_tc"), F.col("cells").alias("_near"))
    rows = cells.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)}).join(near, [image, "_tr", "_tc"], "left")
    off = lambda c, t: (F.col(c) + dbl(0.5)) / dbl(tile) - dbl(0.5) - F.col(t)
    weight = lambda e: F.greatest(dbl(1) - F.abs(off("row", "_tr") - e["dr"]), dbl(0)) * F.greatest(dbl(1) - F.abs(off("col", "_tc") - e["dc"]), dbl(0))
    total = lambda f: F.aggregate("_near", dbl(0), lambda a, e: a + f(e))
    mean = lambda c: F.coalesce(F.try_divide(total(lambda e: weight(e) * e["v"][c]), total(weight)), dbl(0))
    return rows.select(*cells.columns, mean("dr").alias("dy"), mean("dc").alias("dx"))


def displaced_by_field(images: DataFrame, offsets: DataFrame, bands: list[str], image: str = "image", tile: int = 64, most: int = 20, rounds: int = 1) -> DataFrame:
    """(image, row, col, bands): each cell takes the values at its place plus the field there, from the four cells around.

    The field is ``smoothed`` shifts, interpolated; it reaches at most ``most`` cells. Valid cells alone count, and a cell
    around which none is valid is NULL. A field of whole cells takes one cell each.
    """
    limited = lambda c: F.greatest(F.least(F.col(c), dbl(most)), dbl(-most))
    at = field(images.select(image, "row", "col"), smoothed(offsets, image, rounds), image, tile)
    at = at.withColumns({"_y": F.col("row") + F.round(limited("dy"), 9), "_x": F.col("col") + F.round(limited("dx"), 9)})
    around = at.withColumn("_row", F.explode(F.sequence(F.floor("_y"), F.ceil("_y")))).withColumn("_col", F.explode(F.sequence(F.floor("_x"), F.ceil("_x"))))
    around = around.withColumn("_w", (dbl(1) - F.abs(F.col("_y") - F.col("_row"))) * (dbl(1) - F.abs(F.col("_x") - F.col("_col"))))
    source = images.select(image, F.col("row").alias("_row"), F.col("col").alias("_col"), *bands)
    met = around.join(source, [image, "_row", "_col"], "left")
    mean = lambda b: F.try_divide(F.sum(F.when(F.col(b).isNotNull(), F.col("_w")) * F.col(b)), F.sum(F.when(F.col(b).isNotNull(), F.col("_w"))))
    return met.groupBy(image, "row", "col").agg(*[mean(b).alias(b) for b in bands])


def co_registered(images: DataFrame, reference: DataFrame, band: str, bands: list[str], image: str = "image", tile: int = 64, most: int = 20, coarse: int = 4) -> DataFrame:
    """The images moved onto the reference, by the shifts of ``band``."""
    return displaced(images, shifts(images, reference, band, image, tile, most, coarse), bands, image, tile, most)


def co_registered_groups(images: DataFrame, band: str, bands: list[str], group: str, order: str, image: str = "image", tile: int = 64, most: int = 20, coarse: int = 4, rounds: int | None = None) -> DataFrame:
    """(group, image, row, col, bands): in each group all images moved onto its first one, by ``order``, then ``image``.

    The group is a number or a text; images without one are left out. An image belongs to one group. ``rounds``: displaced by
    a field smoothed so often; NULL shifts tiles as a whole.
    """
    named = images.where(F.col(group).isNotNull())
    first = named.groupBy(group).agg(F.min(F.struct(order, image)).alias("_first")).select(group, F.col(f"_first.{image}").alias("_ref"))
    marked = named.join(F.broadcast(first) if first.limit(100_001).count() <= 100_000 else first, group)
    reference, others = marked.where(F.col(image) == F.col("_ref")), marked.where(F.col(image) != F.col("_ref"))
    found = shifts(others.select(group, image, "row", "col", band), reference.select(group, "row", "col", band), band, image, tile, most, coarse, [group])
    moved = displaced(others, found, bands, image, tile, most) if rounds is None else displaced_by_field(others, found, bands, image, tile, most, rounds)
    of = others.select(image, group).distinct()
    return reference.select(group, image, "row", "col", *bands).unionByName(moved.join(of, image).select(group, image, "row", "col", *bands))
