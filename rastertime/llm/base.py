"""Helpers that several corpus operators share: reading, materialising, small lookups, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastertime.sources.scratch import materialise, release, settled, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a lookup table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(big: DataFrame, small: DataFrame, on, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a materialised lookup; broadcasts it only if it has at most ``bound`` rows."""
    if small.limit(bound + 1).count() <= bound:
        small = F.broadcast(small)
    return big.join(small, on, how)


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores after it as make it none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5; the same in every engine and on every rerun."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def ordered_rank(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the gapless rank from 0 of each row in its group, by ``order``; a column of that name is replaced.

    One range shuffle deals the rows out, whatever the size of a group; the position in a sorted partition plus the
    rows of the group in earlier partitions is the rank. Rows that tie in every order column are interchangeable. Other
    columns stay, whatever their names.
    """
    if name not in (*groups, *order):
        df = df.drop(name)
    keys = [F.col(c) for c in (*groups, *order)]
    at, part, base, part_of = (unused(c, df.columns) for c in ("at", "part", "base", "part_of"))
    of = {g: unused(f"{g}_of", df.columns) for g in groups}
    placed = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    first, rows = unused("first", df.columns), unused("rows", df.columns)
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*groups, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(rows))
    starts = starts.withColumn(base, F.coalesce(F.sum(rows).over(before), F.lit(0)) - F.col(first))
    right = starts.select(*[F.col(g).alias(of[g]) for g in groups], F.col(part).alias(part_of), base)
    same = F.col(part) == F.col(part_of)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(of[g]))
    rank = F.col(at) + F.col(base)
    return placed.join(right, same).select(*[rank.alias(name) if c == name else F.col(c) for c in df.columns], *([] if name in df.columns else [rank.alias(name)]))


def ranges(rows: DataFrame, key: str) -> tuple[Column, int]:
    """The number of the range of a long column that a row falls in, and how many ranges of about equal rows there are.

    Only the bounds, fewer than the shuffle partitions, pass through the driver. They are one array in the plan, and a
    row finds its range by halving.
    """
    parts = partitions(rows.sparkSession)
    if parts < 2:
        return F.lit(0), 1
    cut = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = sorted(set(cut))
    if not cuts:
        return F.lit(0), 1
    bounds, steps = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def halve(low: Column, step: Column) -> Column:  # as many bounds as ``low`` are no larger than the key
        return F.when(F.get(bounds, low + step - 1) <= F.col(key), low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), halve), len(cuts) + 1


def ordering_key(column: str) -> Column:
    """An id as a long that sorts nulls first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)).cast("long"))


__all__ = ["attach", "materialise", "n_words", "ordered_rank", "ordering_key", "partitions", "ranges", "release", "settled", "shared_dir", "table", "unit_hash", "unused"]
