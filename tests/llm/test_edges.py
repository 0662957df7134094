"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from rastertime.llm import discriminant, feistel_order, jump_hash, minhash_join, nb_linear, pareto_mix, seed_align, skip_chain_crf, spotsigs, tool_calls
from tests.llm.util import empty, frame, labels, odd


def bench(spark, rows=((1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "short item"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "pareto": lambda spark, d: pareto_mix.pareto_mix(d, F.length("text")),
    "spotsigs": lambda spark, d: spotsigs.compare_with_edited(d),
    "crf": lambda spark, d: skip_chain_crf.find(d, skip_chain_crf.train(d)),
    "minhash": lambda spark, d: minhash_join.near_duplicates(d),
    "quality": lambda spark, d: discriminant.classify(d, labels(spark)),
    "jump": lambda spark, d: jump_hash.shard(d, 8),
    "toxic": lambda spark, d: nb_linear.score(d, nb_linear.train(d, labels(spark))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(spark, name):
    d = odd(spark)
    out = OPERATORS[name](spark, d)
    assert out.count() == d.count()
    assert len(set(out.columns)) == len(out.columns)
    ids = lambda x: sorted((r.doc_id is not None, r.doc_id or 0) for r in x.select("doc_id").collect())
    assert ids(out) == ids(d)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


def test_order_and_copies_of_odd_rows(spark):
    assert feistel_order.training_order(empty(spark), 16).count() == 0
    got = feistel_order.training_order(odd(spark), 1 << 18).collect()
    assert sorted(r.slot for r in got) == list(range(10))
    assert seed_align.copies(empty(spark), bench(spark)).count() == 0
    assert seed_align.copies(odd(spark), bench(spark, [])).count() == 0
    d = frame(spark, [(1, "x alpha beta gamma delta epsilon zeta eta theta y"), (2, "Alpha, beta gamma DELTA epsilon zeta other theta!"), (3, "alpha beta"), (4, None)])
    got = {(r.doc_id, r.item_id) for r in seed_align.copies(d, bench(spark)).collect()}
    assert got == {(1, 1), (2, 1)}
    assert sorted(r.doc_id for r in seed_align.decontaminate(d, bench(spark)).collect()) == [3, 4]


def test_groups_of_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(10 * k + 1, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(1, 60)]
    rows += [(5000 + k, " ".join(f"u{k}_{i}" for i in range(30))) for k in range(20)] + [(9000, "a b"), (9001, "A  b"), (9002, "a c"), (9003, None)]
    got = {r.doc_id: r for r in minhash_join.near_duplicates(frame(spark, rows)).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and root[b] > root[a]:
                    root[b], changed = root[a], True
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.n_shingles == len(sets[i]) and r.kept == (root[i] == i) for i, r in got.items())
    assert sorted(r.doc_id for r in minhash_join.one_of_each(frame(spark, rows), 85).collect()) == sorted({root[i] for i in root})


def test_one_of_each_keeps_nameless_and_drops_repeats(spark):
    out = minhash_join.one_of_each(odd(spark), 80)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert out.columns == odd(spark).columns


def test_spotsig_groups(spark):
    text = "the cat sat on the mat and the dog ran to the house of a friend who was in the garden " * 3
    rows = [(1, text), (2, text), (3, text + " the very end of this long story"), (4, "completely different words are in the sea of an ocean with its own fish")]
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(frame(spark, rows), 70).collect()}
    assert got[1] == got[2] == 1 and got[4] == 4


def test_mix_reaches_its_targets(spark):
    rows = [(i, "word " * (i % 7 + 1)) for i in range(300)]
    out = pareto_mix.pareto_mix(frame(spark, rows), F.regexp_count("text", F.lit("word"))).collect()
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and all(r.taken <= 3 * r.size for r in own)
    assert abs(sum({r.source: r.target for r in out}.values()) - sum(r.size for r in out)) < 1e-6


def test_documents_are_taken_at_their_own_rates(spark):
    rows = [(i, "word " * (2 if i % 2 else 300)) for i in range(400)]  # 2 and 9 bits
    d = frame(spark, rows).withColumn("source", F.lit("a")).cache()
    share = {2: [], 300: []}
    for seed in range(6):
        out = pareto_mix.pareto_mix(d, F.regexp_count("text", F.lit("word")), (1,), share=0.5, seed=f"s{seed}").collect()
        for size in share:
            own = [r for r in out if r.size == size]
            share[size].append(sum(r.copies for r in own) / len(own))
        assert sum(r.taken for r in out) == round(out[0].target) == 30200
    low, high = (sum(x) / len(x) for x in (share[2], share[300]))
    scale = 30200 / (200 * 2 * 2 + 200 * 300 * 9)
    assert abs(low - 2 * scale) < 0.05 and abs(high - 9 * scale) < 0.05


def test_adding_a_shard_moves_rows_only_into_it(spark):
    d = frame(spark, [(i, "x") for i in range(2000)])
    got = jump_hash.shard(d, 8).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 8 for r in moved) and 120 < len(moved) < 330


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [("c", 1, "a", "f", '{"x": 1}', []), ("c", 1, "b", "f", '{"x":"no"}', ["a"]), ("c", 1, "p", "g", "{}", ["q"]), ("c", 1, "q", "g", "{}", ["p"]), ("c", 2, "d", "f", "not json", None), ("c", 2, None, "f", '{"x":2}', []), ("c", 3, "e", "f", '{"x":3,"z":0}', ["zzz"])],
        "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("c", 2, "a", "late"), ("c", 1, "a", "early"), ("c", 2, "lost", "x"), ("c", 2, None, None)], "conv_id string, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "integer", True)], "tool string, field string, type string, required boolean")
    rows = tool_calls.link(calls, results, schemas).orderBy("position").collect()
    by = {r.call_id: r for r in rows if r.call_id}
    assert by["a"].status == "ok" and by["a"].message == '{"arguments":{"x":1},"id":"a","name":"f","result":"early"}'
    assert (by["b"].status, by["b"].level) == ("invalid", 1)
    assert by["p"].status == by["q"].status == "cyclic"
    assert by["d"].status == "invalid" and by["lost"].status == "orphan"
    assert by["e"].problems == "unknown z"
    assert [r.position for r in rows] == list(range(len(rows)))
    assert len(rows) == 7 + 2
    none = tool_calls.link(calls.limit(0), results.limit(0), schemas)
    assert none.count() == 0


def test_one_class_of_labels(spark):
    d = frame(spark, [(i, f"text number {i} with words") for i in range(20)])
    one = labels(spark, [(i, 1, 1) for i in range(20)])
    assert nb_linear.score(d, nb_linear.train(d, one)).agg(F.min("score")).first()[0] > 0.5
    assert discriminant.classify(d, one).agg(F.count("score")).first()[0] == 20
    none = labels(spark, [(99, 1, 1)])
    assert discriminant.classify(d, none).agg(F.count("score")).first()[0] == 20


NAMES = ["a", "b", "at", "part", "base", "first", "rows", "row", "size", "u", "tie", "rank", "extra", "chance", "rest", "ahead", "scale", "measure", "id", "out_id", "out_hash", "component", "doc", "text_hash", "fields", "level", "_id", "_row", "_at", "_part", "_base"]
CLASHING = {
    "pareto": lambda spark, d: (pareto_mix.pareto_mix(d, F.length("text")), {"size"}),
    "one_of_each": lambda spark, d: (minhash_join.one_of_each(d), set()),
    "jump": lambda spark, d: (jump_hash.shard(d, 8), set()),
    "decontaminate": lambda spark, d: (seed_align.decontaminate(d, bench(spark)), set()),
    "toxic": lambda spark, d: (nb_linear.keep_below(d, nb_linear.train(d, labels(spark))), set()),
}


@pytest.mark.parametrize("name", sorted(CLASHING))
def test_columns_of_any_name_stay(spark, name):
    d = odd(spark).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in NAMES})
    out, replaced = CLASHING[name](spark, d)
    assert len(set(out.columns)) == len(out.columns) and set(d.columns) <= set(out.columns)
    for r in out.collect():
        for c in set(NAMES) - replaced:
            assert r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}"


def test_one_id_with_two_texts(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (1, " ".join(f"v{i}" for i in range(60))), (2, " ".join([*base[:50], "x", *base[51:]])), (3, " ".join(f"u{i}" for i in range(60)))]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in minhash_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1, 56), (1, 1, 96), (2, 1, 96), (3, 3, 56)]
    out = minhash_join.one_of_each(frame(spark, rows), 85).collect()
    assert sorted((r.doc_id, r.text[0]) for r in out) == [(1, "v"), (1, "w"), (3, "u")]


def test_types_of_arguments(spark):
    schemas = spark.createDataFrame([("f", "n", "integer", False), ("f", "x", "colour", False), ("f", "y", None, False)], "tool string, field string, type string, required boolean")
    given = ['{"n":1}', '{"n":1.0}', '{"n":12345678901234567890}', '{"n":1.5}', '{"x":"red"}', '{"y":1}', '{"n":"1"}']
    calls = spark.createDataFrame([("c", k, f"k{k}", "f", g, []) for k, g in enumerate(given)], "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>")
    got = {r.turn: r.problems for r in tool_calls.validate(calls, schemas).collect()}
    assert [bool(got[k]) for k in range(len(given))] == [False, False, False, True, True, True, True]


def test_discriminant_against_plain_densities():
    """Scores against class densities written out with determinants and inverses."""
    import numpy as np

    rng = np.random.default_rng(0)
    d = len(discriminant.STATISTICS)
    x = {0: rng.normal(0, 1, (200, d)), 1: rng.normal(0.5, 2, (150, d)) @ rng.normal(0, 0.4, (d, d))}
    model = discriminant.fit({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    both = np.concatenate([x[0], x[1]])
    mean, sd = both.mean(axis=0), both.std(axis=0)
    z = {k: (v - mean) / sd for k, v in x.items()}
    own = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = sum(own[k] * len(z[k]) for k in z) / len(both)

    def log_density(k, row):
        cov = 0.8 * own[k] + 0.2 * pooled
        cov = 0.95 * cov + 0.05 * (np.trace(cov) / d + 1e-3) * np.eye(d)
        far = row - z[k].mean(axis=0)
        return np.log((len(z[k]) + 0.5) / (len(both) + 1)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far @ np.linalg.inv(cov) @ far

    some = rng.normal(0, 1.5, (20, d))
    want = [log_density(1, (r - mean) / sd) - log_density(0, (r - mean) / sd) for r in some]
    assert np.allclose(model.difference(some), want, rtol=1e-6, atol=1e-6)


def test_ngram_weights_against_plain_counts(spark):
    """Log-count ratios of characters against counting strings."""
    import math

    texts = [("grün und gut", 0), ("grün und schön", 0), ("grün und neu", 0), ("böse worte", 1), ("böse worte hier", 1), ("böse worte da", 1)]
    rows = [(i, y, nb_linear.ngrams(t).tobytes()) for i, (t, y) in enumerate(texts)]
    found = spark.createDataFrame(rows, "doc_id long, label int, f binary")
    got = sorted(round(r.ratio, 9) for r in nb_linear.log_ratios(found, certain=0.0).collect())
    sets = [{(n, f" {t} "[i : i + n]) for n in nb_linear.SIZES for i in range(len(t) + 3 - n)} for t, _ in texts]
    want = []
    for g in set().union(*sets):
        n0, n1 = (sum(g in s for s, (_, y) in zip(sets, texts) if y == k) for k in (0, 1))
        if n0 + n1 >= 3:
            want.append(round(math.log((n1 + 1) / 5) - math.log((n0 + 1) / 5), 9))
    assert got == sorted(want)
