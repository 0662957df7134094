"""op7: all documents into shards 0 to 7 by jump consistent hashing of doc_id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.llm.base import table
from rastertime.llm.jump_hash import shard

NAME = "op7_jump_hash_shards"
SHARDS = 8
#: crc32 is not a function of the other engine: the query is tested against a brute-force version.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard(docs, SHARDS, order=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
