"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997), in DataFrame operations only.

A source with words S and target T gives every document floor(T / S) certain copies. The words that these leave of the
target are a sample of fixed size, counted in words, with unequal inclusion probabilities: a document's is its measure
(the bits of its size, unless another is given) times a scale, 1 at most. The scale is solved in closed form from sums by
measure, so that the expected words are those left; documents at 1 are certain. The others are ranked by the odds of a
hashed uniform number over the odds of their inclusion, and the first ones that fill the words are taken.

The rank is never sorted out in full. Two histograms over the rank (by source and bin, summed before the shuffle) find
the narrow bin in which each source's words are reached; only that bin's rows, a millionth of the source, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertime.llm.base import attach, materialise, release, unit_hash

BINS = 1024


def source_targets(base: DataFrame, weights: tuple[int, ...], most: int, share: float = 1.0) -> DataFrame:
    """A row per source: its words, target, certain copies, and the words that these leave of the target.

    ``base`` has source and size. Sources by code point, null last, take ``weights`` in turn. A target stops at ``most``
    times its source's words; the rest is shared out again by weight, in closed form: by rising cap over weight, a
    source is at its cap while that is no more than the level which those after it would get.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = base.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(everything))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("place") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    total = F.sum("source_size").over(whole).cast("double") * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(rising), F.lit(0)).cast("double")
    s = s.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(rising), F.lit(0))).cast("double"))
    s = s.withColumn("open", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(whole))
    even = F.coalesce(F.col("open"), F.lit(0.0)) * F.col("w").cast("double")
    target = F.when(F.col("open").isNull() | (F.col("cap").cast("double") <= even), F.col("cap").cast("double")).otherwise(even)
    s = s.withColumn("target", target)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    s = s.withColumns({"whole_copies": F.floor(rate).cast("long"), "chance": rate - F.floor(rate).cast("double")})
    rest = F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.floor(rate).cast("long") * F.col("source_size")
    full = (rest > 0) & (rest >= F.col("source_size"))  # rounded up to a copy of everything
    s = s.withColumn("whole_copies", F.floor(rate).cast("long") + F.when(full, 1).otherwise(0))
    return s.select("source", "source_size", "target", "whole_copies", F.when(full, F.lit(0).cast("long")).otherwise(rest).alias("rest"))


def scales(base: DataFrame, found: DataFrame) -> DataFrame:
    """(s1, scale, certain): what a measure is multiplied by in each source, and the words of documents at 1.

    By falling measure, a document is at 1 while the scale that the words left and the smaller measures ask for, times
    its measure, is over 1. Measures are few, and their sums are exact.
    """
    of = found.where("rest > 0").select(F.col("source").alias("s1"), "rest")
    sums = base.groupBy("source", "measure").agg(F.sum("size").alias("words"))
    k = attach(sums, of, F.col("source").eqNullSafe(F.col("s1")))
    down = Window.partitionBy("s1").orderBy(F.desc("measure"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("words") * F.col("measure")).over(down.rowsBetween(0, Window.unboundedFollowing))
    k = k.withColumn("c", F.try_divide((F.col("rest") - above).cast("double"), mass.cast("double")))
    fits = F.col("c") * F.col("measure").cast("double") <= 1
    k = k.withColumn("scale", F.max_by("c", F.when(fits, F.col("measure"))).over(Window.partitionBy("s1")))
    sure = F.col("scale") * F.col("measure").cast("double") >= 1
    return k.groupBy("s1").agg(F.first("scale").alias("scale"), F.coalesce(F.sum(F.when(sure, F.col("words"))), F.lit(0)).cast("long").alias("certain"))


def _rank(u: Column, chance: Column) -> Column:
    """Odds of u over odds of the chance; null where that is 1 or where nothing is sampled."""
    return F.when((chance > 0) & (chance < 1), (u / (1 - u)) / (chance / (1 - chance)))


def _chance() -> Column:
    return F.col("scale") * F.col("measure").cast("double")


def _bin(rank: Column) -> Column:
    return F.floor(rank / (1 + rank) * BINS).cast("int")


def _within(rank: Column) -> Column:
    x = rank / (1 + rank) * BINS
    return F.floor((x - F.floor(x)) * BINS).cast("int")


def _reached(found: DataFrame, histogram: DataFrame, at: str, before: str) -> DataFrame:
    """The bin in which a source's words reach its rest, and the words in the bins before it."""
    up_to = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumn("up_to", F.sum("words").over(up_to) + F.col("ahead"))
    h = h.where((F.col("up_to") >= F.col("rest")) & (F.col("up_to") - F.col("words") < F.col("rest")))
    h = h.select(F.col("source").alias("s2"), F.col(at).alias(f"{at}_end"), (F.col("up_to") - F.col("words")).alias(before))
    return found.join(h, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")


def plan(base: DataFrame, weights: tuple[int, ...], most: int, share: float = 1.0) -> DataFrame:
    """Targets, scales and rank thresholds, a row per source. ``base``: source, size, u, measure."""
    found = source_targets(base, weights, most, share)
    found = materialise(found)
    first = materialise(found.join(scales(base, found), F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1").withColumn("rest", F.col("rest") - F.coalesce("certain", F.lit(0))))

    def ranked(of: DataFrame) -> DataFrame:
        of = of.where("rest > 0").drop("source_size", "target", "whole_copies", "certain").withColumnRenamed("source", "s1")
        return attach(base, of, F.col("source").eqNullSafe(F.col("s1"))).withColumn("rank", _rank(F.col("u"), _chance())).where("rank IS NOT NULL")

    bins = ranked(first).groupBy("source", _bin(F.col("rank")).alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    second = materialise(_reached(first, bins.withColumn("ahead", F.lit(0).cast("long")), "bin", "ahead"))
    inner = ranked(second).where(_bin(F.col("rank")) == F.col("bin_end"))
    bins = inner.groupBy("source", _within(F.col("rank")).alias("sub")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("ahead").alias("ahead"))
    out = materialise(_reached(second, bins, "sub", "words_before"))
    release(found, first, second)
    return out


def apply_plan(rows: DataFrame, found: DataFrame, boundary: str = "cut") -> DataFrame:
    """Adds source_size, target, copies and taken to rows with source, size, u, measure and a tie-break column ``tie``.

    ``boundary``: the document at which a source's target is reached is "cut" to the words that are left, which makes
    the taken words equal the rounded target, or taken whole or not at all, whichever is "nearest".
    """
    of = found.withColumnRenamed("source", "s1")
    rows = attach(rows, of, F.col("source").eqNullSafe(F.col("s1"))).drop("s1").withColumn("rank", _rank(F.col("u"), _chance()))
    at, sub = _bin(F.col("rank")), _within(F.col("rank"))
    edge = F.coalesce((at == F.col("bin_end")) & (sub == F.col("sub_end")) & (F.col("rest") > 0), F.lit(False))
    inside = F.coalesce(((at < F.col("bin_end")) | ((at == F.col("bin_end")) & (sub < F.col("sub_end")))) & (F.col("rest") > 0), F.lit(False))
    inside = inside | F.coalesce(_chance() >= 1, F.lit(False))
    plain = rows.where(~edge).withColumn("extra", F.when(inside, F.col("size")).otherwise(F.lit(0).cast("long")))
    up_to = Window.partitionBy("source").orderBy("rank", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("rest") - F.col("words_before") - (F.sum("size").over(up_to) - F.col("size"))
    part = F.when(left >= F.col("size"), F.col("size")).when(left <= 0, F.lit(0).cast("long"))
    part = part.otherwise(left if boundary == "cut" else F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long")))
    rows = plain.unionByName(rows.where(edge).withColumn("extra", part))
    return rows.withColumns({"taken": F.col("whole_copies") * F.col("size") + F.col("extra"), "copies": F.col("whole_copies") + F.when(F.col("extra") > 0, F.lit(1)).otherwise(F.lit(0))})


def bits(size: Column) -> Column:
    """How many binary digits a size has, 1 at least: documents of 1,000 words count 10, of 30,000 words 15."""
    return F.length(F.bin(size)).cast("long")


def pareto_mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: str = "mix", boundary: str = "cut", key: str = "doc_id", measure: Column | None = None) -> DataFrame:
    """Every row of ``docs`` (key, source, ...) with size, source_size, target, taken and copies.

    ``measure``: a whole number from 1 to some hundreds, to which the inclusion probability of the sampled copy is
    proportional. Null sizes count 0, null measures 1; rows without words get the certain copies of their source. A null
    source is a source of its own, the last. A source without words has target 0. Equal keys get equal random numbers and
    tie on size, so repeated rows are interchangeable; the number of a null key comes from the whole row. Empty tables
    stay empty, long texts count as their size. Columns of the five names are replaced, all others stay, whatever their
    names. The draw depends on key and seed alone, so reruns agree. A row per source passes through one task.
    """
    added = ("size", "source_size", "target", "taken", "copies")
    keep = [c for c in docs.columns if c.lower() not in added or c == key]
    words = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    name = F.coalesce(F.col(key).cast("string"), F.to_json(F.struct(*docs.columns)))
    rows = docs.select(F.struct(*keep).alias("row"), "source", words.alias("size"), unit_hash(name, seed).alias("u"), F.col(key).alias("tie"), F.greatest(F.coalesce((bits(words) if measure is None else measure).cast("long"), F.lit(1)), F.lit(1)).alias("measure"))
    base = materialise(rows.select("source", "size", "u", "measure"))
    found = plan(base, weights, most, share)
    release(base)
    return apply_plan(rows, found, boundary).select("row.*", *[c for c in added if c not in keep])
