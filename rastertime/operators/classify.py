"""Sampling, zonal statistics, label encoding, supervised classification."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastertime.sources.scratch import materialise


def names_to_numbers(df: DataFrame, name: str, number: str) -> DataFrame:
    """Class names numbered from 0 in the order of the names; NULL stays NULL.

    The distinct names are dealt by ranges and numbered there; only the sizes of the ranges meet in one task. The codes are
    broadcast up to 100,000 names.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)
    placed = materialise(names.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    codes = placed.join(F.broadcast(starts), "_part").select(name, (F.col("_start") + F.col("_at")).alias(number))
    return df.join(F.broadcast(codes) if placed.limit(100_001).count() <= 100_000 else codes, name, "left")


def sample_points(predictors: DataFrame, points: DataFrame, on: list[str]) -> DataFrame:
    return points.join(predictors, on)


def zonal(df: DataFrame, zone: str, bands: list[str], reducers: dict) -> DataFrame:
    """Each reducer of each band per zone, as {band}_{name}."""
    return df.groupBy(zone).agg(*[f(F.col(b)).alias(f"{b}_{n}") for b in bands for n, f in reducers.items()])


def random_forest(train: DataFrame, rows: DataFrame, features: list[str], label: str, mode: str = "CLASSIFICATION", trees: int = 20, depth: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` with classified (and probability in that mode); rows with a masked feature drop out."""
    assembler = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip")
    whole = rows.where(" AND ".join(f"`{f}` IS NOT NULL" for f in features))
    kind = RandomForestRegressor if mode == "REGRESSION" else RandomForestClassifier
    model = kind(featuresCol="_f", labelCol=label, predictionCol="classified", numTrees=trees, maxDepth=depth, seed=seed).fit(assembler.transform(train.where(F.col(label).isNotNull())))
    out = model.transform(assembler.transform(whole))
    if mode == "PROBABILITY":
        out = out.withColumn("probability", vector_to_array("probability"))
    else:
        out = out.drop("probability")
    return out.drop("_f", "rawPrediction")
