"""op12: SimHash fingerprints of all documents and their groups."""

from pyspark.sql import DataFrame, SparkSession

from rastertime.llm.base import table
from rastertime.llm.simhash import near_duplicates

NAME = "op12_simhash_multi_index"
ORACLE = None  # tested against a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
