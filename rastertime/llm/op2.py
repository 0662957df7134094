"""op2: fingerprints of every document and of its edited text."""

from pyspark.sql import DataFrame, SparkSession

from rastertime.llm.base import table
from rastertime.llm.spotsigs import compare_with_edited

NAME = "op2_spotsigs"
ORACLE = None  # tested against a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))
