"""The test tables as grid observations: a supplier is a pixel, a line item an observation of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl

#: What tells observations apart; (ok, ln) alone repeats.
KEY = ["px", "ok", "ln", "pk", "t"]
BANDS = ["blue", "green", "red", "nir", "swir1", "swir2", "temp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation, one column per band."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("px"), (c("l_suppkey") / 10).cast("long").alias("row"), (c("l_suppkey") % 10).alias("col"),
        c("l_shipdate").alias("t"), F.year("l_shipdate").alias("yr"), F.dayofyear("l_shipdate").alias("doy"),
        c("l_orderkey").alias("ok"), c("l_linenumber").alias("ln"), c("l_partkey").alias("pk"),
        c("l_tax").alias("blue"), c("l_discount").alias("green"), (c("l_quantity") / dbl(100)).alias("red"), (c("l_extendedprice") / dbl(105000)).alias("nir"),
        ((c("l_partkey") % 97).cast("double") / dbl(100)).alias("swir1"), ((c("l_orderkey") % 89).cast("double") / dbl(100)).alias("swir2"),
        (c("l_linenumber") * 5 + 270).cast("double").alias("temp"), ((c("l_linenumber") - 1) * 8).alias("qa"), c("l_returnflag").alias("sensor"), c("l_linestatus").alias("orbit"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as a grid ten cells wide, with their balance as a surface and their nation as a zone."""
    c = F.col
    return table(spark, sf_dir, "supplier").select(
        c("s_suppkey").alias("px"), (c("s_suppkey") / 10).cast("long").alias("row"), (c("s_suppkey") % 10).alias("col"), c("s_acctbal").alias("z"), c("s_nationkey").alias("zone")
    )


#: The same view for the other engine.
OBS_SQL = """obs AS (SELECT l_suppkey AS px, l_suppkey // 10 AS row, l_suppkey % 10 AS col, l_shipdate AS t, year(l_shipdate)::INTEGER AS yr, dayofyear(l_shipdate)::INTEGER AS doy,
 l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_tax AS blue, l_discount AS green, l_quantity / 100::DOUBLE AS red, l_extendedprice / 105000::DOUBLE AS nir,
 (l_partkey % 97)::DOUBLE / 100::DOUBLE AS swir1, (l_orderkey % 89)::DOUBLE / 100::DOUBLE AS swir2, (l_linenumber * 5 + 270)::DOUBLE AS temp, (l_linenumber - 1) * 8 AS qa,
 l_returnflag AS sensor, l_linestatus AS orbit FROM lineitem)"""
GRID_SQL = """grid AS (SELECT s_suppkey AS px, s_suppkey // 10 AS row, s_suppkey % 10 AS col, s_acctbal AS z, s_nationkey AS zone FROM supplier)"""
