"""op3: the calls and results of all conversations, linked, ordered, validated and serialised."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.llm.base import settled, table
from rastertime.llm.tool_calls import from_turns, link

NAME = "op3_tool_call_linking"
#: tool, field, type, required
SCHEMAS = [("lookup", "limit", "integer", True), ("lookup", "query", "string", True), ("reply", "spoken", "boolean", False), ("reply", "text", "string", True), ("step", "at", "integer", True), ("step", "of", "integer", True)]


def further(conversations: DataFrame) -> DataFrame:
    """More calls of a user's turn, by the length n of its text: n % 4 steps in a row after the reply; where 7 divides n a
    lookup with a wrong argument; where 11 does two calls that wait for each other; where 13 does a step with a field too many."""
    user = conversations.where("role = 'user'").select("conv_id", F.col("turn").cast("long").alias("turn"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    number = F.col("turn").cast("string")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    call = lambda call_id, tool, arguments, needs: F.struct(call_id.alias("call_id"), F.lit(tool).alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    last = (F.col("n") % 4).cast("int")
    steps = F.transform(
        F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
        lambda k: call(name("step-", number, "-", k.cast("string")), "step", name('{"of":', last.cast("string"), ',"at":', k.cast("string"), "}"), F.array(F.when(k == 1, name("reply-", number)).otherwise(name("step-", number, "-", (k - 1).cast("string"))))),
    )
    ring = lambda own, other: call(name("ring-", number, f"-{own}"), "reply", F.lit('{"text":"' + own + '"}'), F.array(name("ring-", number, f"-{other}")))
    odd = [
        F.when(F.col("n") % 7 == 0, F.array(call(name("check-", number), "lookup", F.lit('{"query":"x","limit":"many"}'), F.array(name("lookup-", number))))),
        F.when(F.col("n") % 11 == 0, F.array(ring("a", "b"), ring("b", "a"))),
        F.when(F.col("n") % 13 == 0, F.array(call(name("more-", number), "step", F.lit('{"at":1,"extra":true}'), F.array().cast("array<string>")))),
    ]
    kind = "array<struct<call_id: string, name: string, arguments: string, depends_on: array<string>>>"
    found = F.concat(steps.cast(kind), *[F.coalesce(o.cast(kind), F.array().cast(kind)) for o in odd])
    return user.select("conv_id", "turn", F.explode(found).alias("c")).select("conv_id", "turn", "c.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    calls, results = from_turns(conversations)
    calls = calls.unionByName(further(conversations))
    schemas = spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    out = settled(lambda: link(calls, results, schemas))
    return out.select("conv_id", "position", "turn", "level", "call_id", "name", "status", "problems", "message")


ORACLE = """
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT * FROM t WHERE role = 'user'), a AS (SELECT * FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, 'reply-' || (turn - 1) AS call_id, min({'turn': turn, 'content': text}) AS first FROM a GROUP BY 1, 2),
x AS (SELECT conv_id, turn, length(text) AS n FROM u),
c AS (SELECT conv_id, turn, 0 AS level, 'lookup-' || turn AS call_id, 'lookup' AS name,
             '{"limit":' || length(text) || ',"query":' || to_json(split_part(text, chr(10), 1)) || '}' AS args FROM u
      UNION ALL
      SELECT conv_id, turn, 1 AS level, 'reply-' || turn, 'reply', '{"spoken":' || CASE WHEN length(text) > 0 THEN 'true' ELSE 'false' END || ',"text":' || to_json(text) || '}' FROM u
      UNION ALL SELECT conv_id, turn, 1 + k, 'step-' || turn || '-' || k, 'step', '{"at":' || k || ',"of":' || (n % 4) || '}' FROM x, unnest(range(1, n % 4 + 1)) AS r(k)
      UNION ALL SELECT conv_id, turn, 1, 'check-' || turn, 'lookup', '{"limit":"many","query":"x"}' FROM x WHERE n % 7 = 0
      UNION ALL SELECT conv_id, turn, NULL, 'ring-' || turn || '-' || k, 'reply', '{"text":"' || k || '"}' FROM x, (VALUES ('a'), ('b')) AS r(k) WHERE n % 11 = 0
      UNION ALL SELECT conv_id, turn, 0, 'more-' || turn, 'step', '{"at":1,"extra":true}' FROM x WHERE n % 13 = 0),
l AS (SELECT c.conv_id, c.turn, c.level::INTEGER AS level, c.call_id, c.name, CASE WHEN c.level IS NULL THEN 'cyclic' WHEN c.call_id[1:5] IN ('check', 'more-') THEN 'invalid' WHEN r.first IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
             CASE c.call_id[1:5] WHEN 'check' THEN 'limit is no integer' WHEN 'more-' THEN 'missing of; unknown extra' ELSE '' END AS problems,
             '{"arguments":' || args || ',"id":"' || c.call_id || '","name":"' || name || '","result":' || CASE WHEN r.first IS NULL THEN 'null' ELSE to_json(r.first.content) END || '}' AS message
      FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
      UNION ALL
      SELECT a.conv_id, a.turn, NULL, 'reply-' || (a.turn - 1), NULL, 'orphan', '', '{"arguments":null,"id":"reply-' || (a.turn - 1) || '","name":null,"result":' || to_json(a.text) || '}'
      FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(level, 2147483647), call_id, message) - 1 AS position, turn, level, call_id, name, status, problems, message FROM l
"""
