"""op13: words of all documents, with the commoner spelling that each is a variant of."""

from pyspark.sql import DataFrame, SparkSession

from rastertime.llm.base import table
from rastertime.llm.sql import CRC_TABLE, crc32_of_utf8
from rastertime.llm.trie_join import spelling_groups

NAME = "op13_trie_active_nodes"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
p AS (SELECT id, run, count(*) AS times FROM o GROUP BY ALL),
h AS (SELECT run, times, {crc32_of_utf8("id || ':' || run")} AS h FROM p, crc_table),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
d AS (SELECT word, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM v, unnest(range(length(word))) AS t(i)),
e AS (SELECT DISTINCT a, b FROM (
  SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.head = y.head AND x.tail = y.tail AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT d.word, v.word FROM d JOIN v ON v.word = d.head || d.tail
  UNION ALL SELECT v.word, d.word FROM d JOIN v ON v.word = d.head || d.tail)),
g AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM e JOIN v ON v.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM v LEFT JOIN g ON g.a = v.word),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) WHERE r.next IS NULL
"""
