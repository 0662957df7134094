"""op8: a toxicity score for every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.llm.base import table
from rastertime.llm.nb_linear import held_out, score, train

NAME = "op8_nb_char_ngrams"
CUT = 0.3
ORACLE = None  # a trained model: tested by held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "toxic")
    return score(docs, model, CUT).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"))
