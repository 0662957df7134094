"""The corpus pipeline: toxicity, near-duplicates, benchmark copies, mixture of sources, shards.

Each stage is (spark, docs, sf_dir) -> DataFrame over every row that the stage before kept. All but the last return the
columns of ``docs``, extra ones included, whatever their names. Null and empty texts pass the filters; an empty table stays
empty. Repeated rows are judged alike: toxicity and benchmark copies keep or drop all of them, near-duplicates keep one (all
with a null id), the mixture draws each by its id. A score of TOXIC goes, a likeness of PERCENT is a copy. Whole texts of any
length are read, and memory is in proportion to the longest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.llm.base import n_words, release, settled, table
from rastertime.llm.jump_hash import shard
from rastertime.llm.minhash_join import one_of_each
from rastertime.llm.nb_linear import keep_below, train
from rastertime.llm.pareto_mix import pareto_mix
from rastertime.llm.seed_align import decontaminate

#: A document is rejected from this toxicity score on.
TOXIC = 0.3
#: Hundredths of the union of two documents' five-word shingles from which they are copies.
PERCENT = 80
#: Weights of the sources by code point, in turn, and times that a document is taken at most.
WEIGHTS, MOST = (1, 2, 3), 3
SHARDS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC under a model of the labelled ones."""
    return keep_below(docs, train(docs, table(spark, sf_dir, "labels"), "toxic"), TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return one_of_each(docs, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, exact or edited."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as a Pareto order sample takes, whole ones only."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("n_words"), F.struct(*docs.columns).alias("document"))
    mixed = pareto_mix(rows, F.col("n_words"), WEIGHTS, MOST, boundary="nearest")
    return mixed.where("copies > 0").select("document", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("document.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its gapless place in it; grown_shard is where one more shard would put it."""
    return shard(docs, SHARDS)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: The trained stage can't be put in SQL; the operators are tested on their own, the stages for what they must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
