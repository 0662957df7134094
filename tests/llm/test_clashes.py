"""Operators that drop or replace columns, with columns named like their own inner ones; what they leave in the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from rastertime.llm import discriminant, feistel_order, simhash, skip_chain_crf, spotsigs, tool_calls
from rastertime.llm.base import materialise, settled, shared_dir
from tests.llm.test_edges import NAMES
from tests.llm.util import labels, odd

MORE = [*NAMES, "label", "other", "stats", "first", "given", "problems", "status", "name", "class", "chain", "list", "pid", "key", "h", "fp", "list", "n", "kind"]


def clashing(df, names=MORE):
    return df.withColumns({c: F.lit(f"{c}!") for c in dict.fromkeys(names) if c not in df.columns})


@pytest.mark.parametrize(
    "run",
    [
        lambda spark, d: discriminant.classify(d, labels(spark)),
        lambda spark, d: skip_chain_crf.find(d, skip_chain_crf.train(d)),
        lambda spark, d: spotsigs.compare_with_edited(d),
        lambda spark, d: simhash.near_duplicates(d),
        lambda spark, d: feistel_order.training_order(d, 1 << 18),
    ],
    ids=["classify", "find", "compare", "simhash", "order"],
)
def test_inner_names(spark, run):
    plain, more = run(spark, odd(spark)), run(spark, clashing(odd(spark)))
    common = [c for c in plain.columns if c in more.columns and c not in MORE]
    assert sorted(map(repr, plain.select(common).collect())) == sorted(map(repr, more.select(common).collect()))


def test_tool_calls(spark):
    calls = spark.createDataFrame([("c", 1, "a", "f", '{"x": 1}', []), ("c", 1, "b", "f", '{"x": 2}', ["a"])], "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("c", 2, "a", "yes")], "conv_id string, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "integer", True)], "tool string, field string, type string, required boolean")
    want = tool_calls.link(calls, results, schemas).collect()
    more = [x for x in MORE if x not in ("name", "text")]
    assert sorted(map(repr, tool_calls.link(clashing(calls, more), clashing(results, more), schemas).collect())) == sorted(map(repr, want))
    kept = tool_calls.validate(clashing(calls, ["fields", "given", "level"]), schemas)
    assert {(r.fields, r.given, r.level) for r in kept.collect()} == {("fields!", "given!", "level!")}


def test_settled_leaves_one_table(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))

    def make():
        a = materialise(spark.range(5))
        return settled(lambda: materialise(a.where("id > 1")).union(materialise(a)))

    assert settled(make).count() == 8
    assert len(set(os.listdir(folder)) - before) == 1


def test_shortened_tokens_meet_at_one_edit():
    for a, b, near in [("4111-1111-1111", "4111-1111-111", True), ("abcdefgh9", "abcdxfgh9", True), ("abcdefgh9", "badcefgh9", False), ("9" * 5000 + "a", "9" * 5000 + "b", True), ("9" * 300, "8" + "9" * 300, True)]:
        x = {skip_chain_crf.whole_hash(a), *skip_chain_crf.shortened(a)}
        y = {skip_chain_crf.whole_hash(b), *skip_chain_crf.shortened(b)}
        assert bool(x & y) == near
    assert skip_chain_crf.shortened("ab") == {skip_chain_crf.whole_hash("a"), skip_chain_crf.whole_hash("b")}
