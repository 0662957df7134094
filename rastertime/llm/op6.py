"""op6: a quality score for every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.llm.base import table
from rastertime.llm.discriminant import classify
from rastertime.llm.text import held_out

NAME = "op6_quadratic_discriminant"
CUT = 0.7
ORACLE = None  # a trained model: tested by held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"), "quality", CUT)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"))
