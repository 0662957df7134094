"""op1: all documents mixed to source weights 1, 2, 3, ... of 100 % of all words."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.llm.base import materialise, n_words, table
from rastertime.llm.pareto_mix import pareto_mix

NAME = "op1_pareto_mix"
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    out = pareto_mix(materialise(docs), F.col("words"), WEIGHTS, MOST, seed=SEED)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"))


ORACLE = """
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM base GROUP BY source),
s1 AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap, (source_size * 3)::DOUBLE / ((place - 1) % 3 + 1)::DOUBLE AS ratio FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE)
                 / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
       FROM s1 WINDOW before AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS open FROM s2),
s4 AS (SELECT *, CASE WHEN open IS NULL OR cap::DOUBLE <= open * w::DOUBLE THEN cap::DOUBLE ELSE open * w::DOUBLE END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END AS rate FROM s4),
s6 AS (SELECT source, source_size, target, floor(rate)::BIGINT AS c0, floor(target + 0.5::DOUBLE)::BIGINT - floor(rate)::BIGINT * source_size AS rest0 FROM s5),
s7 AS (SELECT source, source_size, target, c0 + CASE WHEN rest0 > 0 AND rest0 >= source_size THEN 1 ELSE 0 END AS c,
              CASE WHEN rest0 > 0 AND rest0 >= source_size THEN 0 ELSE rest0 END AS rest FROM s6),
k0 AS (SELECT source, length(bin(size)) AS m, sum(size)::BIGINT AS words FROM base GROUP BY 1, 2),
k1 AS (SELECT k0.source, m, (rest - coalesce(sum(words) OVER (PARTITION BY k0.source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                        / nullif((sum(words * m) OVER (PARTITION BY k0.source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 0) AS ck
       FROM k0 JOIN s7 ON k0.source IS NOT DISTINCT FROM s7.source WHERE rest > 0),
k2 AS (SELECT source, arg_max(ck, m) FILTER (WHERE ck * m::DOUBLE <= 1) AS scale FROM k1 GROUP BY source),
r0 AS (SELECT b.doc_id, b.size, b.u, s.*, k.scale * length(bin(b.size))::DOUBLE AS pi
       FROM base b JOIN s7 s ON b.source IS NOT DISTINCT FROM s.source LEFT JOIN k2 k ON b.source IS NOT DISTINCT FROM k.source),
r1 AS (SELECT *, CASE WHEN pi >= 1 THEN 0 WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM r0),
r2 AS (SELECT *, rest - (sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) - size) AS room FROM r1),
r3 AS (SELECT *, CASE WHEN rest <= 0 OR q IS NULL OR room <= 0 THEN 0 WHEN room >= size THEN size ELSE room END AS extra FROM r2)
SELECT doc_id, size, source_size, target, (c * size + extra)::BIGINT AS taken, (c + CASE WHEN extra > 0 THEN 1 ELSE 0 END)::BIGINT AS copies FROM r3
"""
