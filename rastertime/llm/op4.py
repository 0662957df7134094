"""op4: personal data in every document."""

from pyspark.sql import DataFrame, SparkSession

from rastertime.llm.base import table
from rastertime.llm.skip_chain_crf import find, train

NAME = "op4_skip_chain_crf"
ORACLE = None  # tested against the plain patterns


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs)).drop("text")
