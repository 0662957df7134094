"""Connected components of an edge table, by contraction in rounds of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.sources.scratch import materialise, release

#: Edges for each file of a round's tables.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches. Ids are longs; loops are allowed.

    Each round points every node to its smallest neighbour, follows the pointers to their ends by doubling, and
    contracts the edges to those ends, so the rounds grow as the logarithm of a component's diameter. Minima sum before
    the shuffle; joins on an end that very many nodes point to are split by adaptive execution. Tables of a round are
    deleted after it; the result is a table that the caller may release.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    left = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    files = max(1, min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-left.count() // EDGES)))
    found = None
    while True:
        to = left.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "id")
        to = materialise(to, files)
        while True:  # pointer doubling
            far = to.select(F.col("id").alias("to"), F.col("to").alias("far"))
            jumped = materialise(to.join(far, "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), files)
            release(to)
            to = jumped
            if jumped.where("moved").isEmpty():
                break
        ends = to.select("id", F.col("to").alias("end"))
        if found is None:
            found = materialise(ends, files)
        else:
            more = ends.select(F.col("id").alias("end"), F.col("end").alias("further"))
            new = materialise(found.join(more, "end", "left").select("id", F.coalesce("further", "end").alias("end")), files)
            release(found)
            found = new
        x, y = ends.select(F.col("id").alias("a"), F.col("end").alias("a2")), ends.select(F.col("id").alias("b"), F.col("end").alias("b2"))
        fewer = materialise(left.join(x, "a").join(y, "b").where("a2 != b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), files)
        release(left, to)
        left = fewer
        if left.isEmpty():
            release(left)
            out = found.withColumnRenamed("end", "component")
            out._written = found._written
            return out
