"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import ordered_rank

#: The multiplier of the generator that the published algorithm steps its 64-bit key with.
STEP = 2862933555777941757
_LOW32 = (1 << 32) - 1
#: A key makes about ln(shards) jumps; that this many do not suffice has no practical probability, and raises.
MOST_JUMPS = 160


def _times_step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * STEP + 1 modulo 2^64 in halves of 32 bits; no product passes 2^63, so ANSI arithmetic holds."""
    a, b = F.lit(STEP >> 32), F.lit(STEP & _LOW32)
    low, top = F.lit(0xFFFF), F.lit(_LOW32)
    p0 = lo.bitwiseAND(low) * b + F.lit(1)
    p1 = F.shiftright(lo, 16) * b
    t = F.shiftleft(p1.bitwiseAND(low), 16) + p0
    carry = F.shiftright(t, 32) + F.shiftright(p1, 16)

    def by(x: Column, c: Column) -> Column:  # modulo 2^32
        return x.bitwiseAND(low) * c + F.shiftleft((F.shiftright(x, 16) * c.bitwiseAND(low)).bitwiseAND(low), 16)

    return (carry + by(hi, b) + by(lo, a)).bitwiseAND(top), t.bitwiseAND(top)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit key. A null key counts as 0. Adding a shard moves rows only into it."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), zero.alias("j"), F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW32)).alias("lo")
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _times_step(s["hi"], s["lo"])
        to = ((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        on = s["j"] < F.lit(shards)
        return F.struct(
            F.when(on, s["j"]).otherwise(s["b"]).alias("b"), F.when(on, to).otherwise(s["j"]).alias("j"), F.when(on, hi).otherwise(s["hi"]).alias("hi"), F.when(on, lo).otherwise(s["lo"]).alias("lo")
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, jump)
    at = F.when(end["j"] >= F.lit(shards), end["b"])
    return (at if shards <= MOST_JUMPS else F.coalesce(at, F.raise_error(F.lit("jump hashing did not end")).cast("long"))).cast("int")


def hash_key(column: Column) -> Column:
    """A stable 64-bit key of any value, for keys that aren't integers. Nulls get null."""
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, shards: int, key: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """Adds shard, grown_shard (with one shard more) and slot, gapless from 0 in each shard by ``order`` (default: the key).

    All input columns stay; columns of those three names are replaced. Null keys share the shard of key 0, rows with
    equal keys share a shard and get neighbouring slots in any order, an empty table stays empty. Integers are keys
    as they are, other types through an MD5. Rows are dealt out by ranges of (shard, key), so a shard with most rows
    still spreads over many tasks.
    """
    kind = dict(docs.dtypes)[key]
    k = F.col(key) if kind in ("bigint", "int", "smallint", "tinyint") else hash_key(F.col(key))
    docs = docs.drop("shard", "grown_shard", "slot")
    placed = docs.withColumns({"shard": jump_shard(k, shards), "grown_shard": jump_shard(k, shards + 1)})
    return ordered_rank(placed, ["shard"], order or [key], "slot")
