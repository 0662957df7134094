"""op10: copies of benchmark items in all documents."""

from pyspark.sql import DataFrame, SparkSession

from rastertime.llm.base import table
from rastertime.llm.seed_align import copies

NAME = "op10_seed_align"
ORACLE = None  # tested against full alignment of every pair


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
