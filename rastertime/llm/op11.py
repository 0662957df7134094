"""op11: all conversations, damaged, and what repairs them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.llm.base import table
from rastertime.llm.sql import CRC_TABLE, crc32_of_ascii
from rastertime.llm.turn_repair import COUNTS, digests, repair

NAME = "op11_viterbi_turn_repair"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows by crc32 of conv_id:turn mod 20: 0 goes, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 is a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), chance.cast("int").alias("chance"))
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("chance") == 0, 0).when(F.col("chance") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_"))
    return rows.drop("_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    report = repair(rows)
    hashes = digests(rows, report)
    of = lambda df: df.withColumnRenamed("conv_id", "of")
    ids = given.select("conv_id").distinct()
    out = ids.join(of(report), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").join(of(hashes), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _add(path: str, cost: str, edit: str) -> str:
    """A path is its cost in eight digits and its audit; null paths stay null."""
    return f"(lpad((substr({path}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({path}, 9) || '{edit}')"


_BEFORE_USER = "least(s0, s1, s3)"
_STEP = f"""
  SELECT r.c, r.i, {_add('s0', '4', 'D')} AS n0,
         CASE WHEN must OR ini <> 's' THEN {_add('s1', '4', 'D')} ELSE least({_add('s1', '4', 'D')}, {_add('s0', 'more', 'K')}) END AS n1,
         CASE WHEN must THEN {_add('s2', '4', 'D')} ELSE least({_add('s2', '4', 'D')}, {_add(_BEFORE_USER, '(3 + more)', 'R')}, CASE WHEN ini = 'u' THEN {_add(_BEFORE_USER, 'more', 'K')} END) END AS n2,
         CASE WHEN must THEN {_add('s3', '4', 'D')} ELSE least({_add('s3', '4', 'D')}, {_add('s2', '(3 + more)', 'R')}, CASE WHEN ini = 'a' THEN {_add('s2', 'more', 'K')} END) END AS n3
  FROM v JOIN r ON r.c = v.c AND r.i = v.i + 1"""

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_of_ascii("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS chance FROM conversations, crc_table),
w AS (SELECT conv_id, turn, CASE WHEN chance = 4 THEN 'user' ELSE role END AS role, CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM k, unnest(range(CASE chance WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(n)),
o AS (SELECT *, coalesce(conv_id::VARCHAR, 'null') AS c, substr(role, 1, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM w),
l AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth FROM o),
f AS (SELECT *, CASE WHEN ending = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
             lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS pair FROM l),
r AS (SELECT c, i, ini, role, text, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM f),
v AS (SELECT DISTINCT c, 0::BIGINT AS i, '00000000' AS s0, NULL::VARCHAR AS s1, '00000003I' AS s2, '00000006II' AS s3 FROM r
      UNION ALL
      SELECT c, i, n0, n1, m2, least(n3, {_add('m2', '3', 'I')}) FROM (SELECT *, least(n2, {_add('least(n0, n1, n3)', '3', 'I')}) AS m2 FROM ({_STEP}))),
e AS (SELECT c, arg_max(least(s0, s3), i) AS best FROM v GROUP BY c),
x AS (SELECT c, j, substr(best, 8 + j, 1) AS edit FROM e, unnest(range(1, length(best) - 7)) AS t(j)),
y AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY c ORDER BY j) AS i, count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY c ORDER BY j) AS place FROM x),
z AS (SELECT y.*, r.role AS own, r.text, max(CASE WHEN edit = 'K' AND place = 1 AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.c) AS led
      FROM y LEFT JOIN r ON r.c = y.c AND r.i = y.i AND edit <> 'I'),
q AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN own WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole FROM z WHERE edit <> 'D' GROUP BY c),
g AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
             count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(best, 1, 8)::BIGINT, 0)::BIGINT AS cost, coalesce(substr(best, 9), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS c FROM conversations) LEFT JOIN g USING (c) LEFT JOIN e USING (c) LEFT JOIN q USING (c)
"""
