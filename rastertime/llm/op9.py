"""op9: all documents as fixed-length sequences of byte ids in a keyed training order."""

from pyspark.sql import DataFrame, SparkSession

from rastertime.llm.base import table
from rastertime.llm.feistel_order import training_order

NAME = "op9_feistel_order"
LENGTH, SHARD_ROWS, SEED = 1024, 4096, 20240229
ORACLE = None  # tested by an exact round trip and a brute-force permutation


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"), LENGTH, SHARD_ROWS, SEED)
