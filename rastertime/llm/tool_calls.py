"""Tool-call linking in DataFrame operations: hash join by identifier, topological order, validation, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import BROADCAST_ROWS, materialise, ordered_rank, unused

#: What a schema's types accept, as the types that Spark gives parsed JSON.
TYPES = {"string": "STRING", "integer": "(BIGINT|DECIMAL[(][0-9]+,0[)])", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def canonical_json(text: Column) -> Column:
    """JSON with keys in order at every depth and no blanks; null if it can't be parsed or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def levels(calls: DataFrame) -> DataFrame:
    """Adds level: how many calls of the same turn a call waits for in a row; null where they wait for one another.

    A call may use calls of earlier turns, which turn order puts first anyway, and calls of its own turn. A dependency
    on an unknown call or a later turn doesn't count here. Rounds are as many as the longest chain within one turn.
    """
    calls = calls.drop("level")
    nodes = calls.select("conv_id", "call_id", "turn").distinct()
    needs = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("on")).distinct()
    inside = nodes.select("conv_id", F.col("call_id").alias("on"), "turn")
    edges = materialise(needs.join(inside, ["conv_id", "on", "turn"], "left_semi"))
    waiting = materialise(edges.select("conv_id", "call_id", "turn").distinct())
    done = None
    depth = 0
    while not waiting.isEmpty():
        depth += 1
        # free: all that it waits for, within its turn, is no longer waiting
        held = edges.join(waiting.select("conv_id", F.col("call_id").alias("on"), "turn"), ["conv_id", "on", "turn"], "left_semi")
        free = materialise(waiting.join(held.select("conv_id", "call_id", "turn").distinct(), ["conv_id", "call_id", "turn"], "left_anti"))
        if free.isEmpty():
            break
        found = free.withColumn("level", F.lit(depth))
        done = found if done is None else done.unionByName(found)
        waiting = materialise(waiting.join(free, ["conv_id", "call_id", "turn"], "left_anti"))
    stuck = waiting.withColumn("level", F.lit(-1))
    done = stuck if done is None else done.unionByName(stuck)
    out = calls.join(done, ["conv_id", "call_id", "turn"], "left")
    return out.withColumn("level", F.when(F.col("level").isNull(), 0).when(F.col("level") >= 0, F.col("level")))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds problems: an array of what is wrong with a call's arguments, empty if nothing is.

    ``schemas``: tool, field, type, required. A tool without any field listed takes any object. Whole numbers of any length
    are integers, 1.0 too; no value is of a type that TYPES doesn't name, or of a null one. Repeated fields are named each
    time. An empty table stays empty; columns of ``calls`` stay, whatever their names, but for problems.
    """
    calls = calls.drop("problems")
    listed, parsed = unused("fields", calls.columns), unused("given", calls.columns)
    fields = schemas.groupBy(F.col("tool").alias("name")).agg(F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias(listed))
    fields = materialise(fields)
    if fields.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        fields = F.broadcast(fields)
    given = F.from_json(F.when(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.col("arguments")), "map<string,variant>")
    rows = calls.join(fields, "name", "left").withColumn(parsed, given)

    def kind(v: Column) -> Column:
        return F.schema_of_variant(v)

    accepted = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    missing = F.transform(F.filter(listed, lambda f: f["required"] & ~F.map_contains_key(parsed, f["field"])), lambda f: F.concat(F.lit("missing "), f["field"]))
    wrong = F.transform(
        F.filter(listed, lambda f: F.map_contains_key(parsed, f["field"]) & ~F.coalesce(F.rlike(kind(F.col(parsed)[f["field"]]), F.concat(F.lit("^"), accepted[f["type"]], F.lit("$"))), F.lit(False))),
        lambda f: F.concat(f["field"], F.lit(" is no "), f["type"]),
    )
    known = F.transform(listed, lambda f: f["field"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(parsed), known)), lambda k: F.concat(F.lit("unknown "), k))
    problems = F.when(F.col(parsed).isNull(), F.array(F.lit("no JSON object"))).when(F.col(listed).isNull(), F.array().cast("array<string>"))
    return rows.withColumn("problems", problems.otherwise(F.concat(missing, wrong, extra))).drop(parsed, listed)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call, and per result without a call: conv_id, position, level, call_id, name, status, problems, message.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids). ``results``: conv_id,
    turn, call_id, content. position is the place in the conversation's topological order: by turn, then by level
    within the turn, then id; calls that wait for one another come last in their turn. status is ok, unanswered,
    invalid (arguments), cyclic, or orphan (a result without a call), the first of cyclic, invalid, unanswered that
    holds. Of several results of a call the earliest counts, then the least content. message is canonical JSON of call and
    result. Nulls: a null id never links, null arguments are invalid, a null content is an answer. Repeated calls stay as
    rows of their own, and rows that tie in all of the order are alike. Empty tables on any side give the rows of the
    others; arguments of any length are parsed whole. Other columns, whatever their names, are not read.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    results = results.select("conv_id", "turn", "call_id", "content")
    first = results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.coalesce("content", F.lit("")).alias("content"))).alias("first"), F.count(F.lit(1)).alias("n_results"))
    linked = validate(levels(calls), schemas).join(first, ["conv_id", "call_id"], "left")
    status = F.when(F.col("level").isNull(), "cyclic").when(F.size("problems") > 0, "invalid").when(F.col("first").isNull(), "unanswered").otherwise("ok")
    body = F.struct(
        F.coalesce(canonical_json(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("invalid")))).alias("args"), F.col("first.content").alias("content")
    )
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    linked = linked.withColumns({"status": status, "_args": body["args"], "_name": quoted(F.col("name")), "_id": quoted(F.col("call_id")), "_content": quoted(F.col("first.content"))})
    message = F.concat(F.lit('{"arguments":'), F.col("_args"), F.lit(',"id":'), inner("_id"), F.lit(',"name":'), inner("_name"), F.lit(',"result":'), inner("_content"), F.lit("}"))
    linked = linked.select("conv_id", "turn", F.col("level"), "call_id", "name", "status", F.array_join("problems", "; ").alias("problems"), message.alias("message"))
    orphans = results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumns({"_id": quoted(F.col("call_id")), "_content": quoted(F.col("content"))})
    lone = F.concat(F.lit('{"arguments":null,"id":'), inner("_id"), F.lit(',"name":null,"result":'), inner("_content"), F.lit("}"))
    nothing = F.lit(None).cast("string")
    orphans = orphans.select("conv_id", "turn", F.lit(None).cast("int").alias("level"), "call_id", nothing.alias("name"), F.lit("orphan").alias("status"), F.lit("").alias("problems"), lone.alias("message"))
    rows = linked.unionByName(orphans).withColumn("_late", F.coalesce("level", F.lit((1 << 31) - 1)))
    return ordered_rank(rows, ["conv_id"], ["turn", "_late", "call_id", "message"], "position").drop("_late")


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls ``lookup`` with its first line and ``reply`` with
    all of it, which needs the lookup and the reply before; the assistant's next turn is the result of that reply."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    user = turns.where("role = 'user'")
    name = lambda what, back: F.concat(F.lit(what), (F.col("turn") - back).cast("string"))
    line = F.split("text", "\n", 2)[0]
    lookup = user.select("conv_id", "turn", name("lookup-", 0).alias("call_id"), F.lit("lookup").alias("name"), F.to_json(F.struct(line.alias("query"), F.length("text").alias("limit"))).alias("arguments"), F.array().cast("array<string>").alias("depends_on"))
    reply = user.select(
        "conv_id", "turn", name("reply-", 0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text"), (F.length("text") > 0).alias("spoken"))).alias("arguments"), F.array(name("lookup-", 0), name("reply-", 2)).alias("depends_on")
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name("reply-", 1).alias("call_id"), F.col("text").alias("content"))
    return lookup.unionByName(reply), results


