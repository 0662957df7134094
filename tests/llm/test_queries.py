"""The registered queries: SQL where there is one, contract columns, and the pipeline's stages."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rastertime.llm import queries as Q
from tests.compare import same
from tests.conftest import SF


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, duck, name):
    same(Q.QUERIES[name](spark, SF), duck, Q.ORACLES[name])


def test_shards(spark, docs):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    got = Q.QUERIES["op7_jump_hash_shards"](spark, SF).collect()
    text = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9))
    for s in range(8):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_spotsigs_against_edits(spark, docs):
    from rastertime.llm.spotsigs import likeness, shown, spots

    got = {r.doc_id: r for r in Q.QUERIES["op2_spotsigs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(spots(t)), shown(spots(edited)))
        assert (r.near_edited, r.near_next) == (likeness(spots(t), spots(edited)), likeness(spots(t), spots(after)))
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.4


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    from rastertime.llm.skip_chain_crf import luhn

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in Q.QUERIES["op4_skip_chain_crf"](spark, SF).collect()}
    seen = Counter()
    for i, t in docs:
        base = plain_spans(t or "")
        n = Counter(k for k, _, _ in base)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, r.spans.split(",")))
        seen += n
    assert min(seen[k] for k in ("email", "ip", "card", "phone")) > 0


def test_odd_texts_of_personal_data():
    from rastertime.llm.skip_chain_crf import KINDS, base_spans

    rng = np.random.default_rng(0)
    cases = ["a@b.c@d.e a@@b.c .@a.b", "1.2.3.4.5 300.1.1.1 01.002.3.255 1.1.1.1.1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999 +12 +1-2-3", "", "@", "a" * 1000 + "@"]
    cases += ["".join(rng.choice(list("ab1234567890@.+- ()%_"), 300)) for _ in range(200)]
    for t in cases:
        assert [(KINDS[k], a, b) for k, a, b in base_spans(t)] == plain_spans(t)


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quadratic_discriminant", "quality", 0.95), ("op8_nb_char_ngrams", "toxic", 0.8)])
def test_scores_on_the_held_out_fold(spark, name, label, least):
    import duckdb

    folder = SF.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in Q.QUERIES[name](spark, folder).collect()}
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    cut = 0.7 if label == "quality" else 0.3
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    y = {i: v for i, v in duckdb.sql(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall() if i in got and got[i].held_out}
    pos, neg = ([got[i].score for i in y if y[i] == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > least


def test_equal_texts_score_alike(spark, docs):
    got = {r.doc_id: r.score for r in Q.QUERIES["op8_nb_char_ngrams"](spark, SF).collect()}
    by = {}
    for i, t in docs:
        by.setdefault(t, set()).add(got[i])
    assert all(len(v) == 1 for v in by.values())


def test_training_order_round_trip(spark, docs, tmp_path):
    from rastertime.llm.feistel_order import END, PAD, permuted, read_slots, shard_name, training_order, write_shards
    from rastertime.llm.base import table

    df = training_order(table(spark, SF, "documents"), 64, 100, 7)
    rows = sorted(df.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 128 for r in rows)
    want, number = {}, 0
    for i, t in docs:
        ids = [*(t or "").encode(), END]
        for j in range(0, len(ids), 64):
            part = ids[j : j + 64]
            want[int(permuted(np.array([number]), len(rows), 7)[0])] = (i, j // 64, len(part), np.array(part + [PAD] * (64 - len(part)), "<u2").tobytes())
            number += 1
    assert {r.slot: (r.doc_id, r.part, r.n_tokens, bytes(r.payload)) for r in rows} == want
    folder = tmp_path / "s"
    write_shards(df, str(folder), 64, 100)
    files = sorted(folder.glob("*.bin"))
    assert [f.name for f in files] == [shard_name(k) for k in range(-(-len(rows) // 100))]
    assert b"".join(f.read_bytes() for f in files) == b"".join(want[k][3] for k in range(len(rows)))
    assert [s for s, _ in read_slots(str(folder), 150)] == list(range(150, len(rows)))
    assert all(ids.tobytes() == want[s][3] for s, ids in read_slots(str(folder), len(rows) - 120))
    before = {f.name: f.read_bytes() for f in files}
    write_shards(df, str(folder), 64, 100)
    assert {f.name: f.read_bytes() for f in folder.glob("*.bin")} == before
    (folder / "notes.txt").write_text("stays")
    write_shards(df.where("slot < 6"), str(folder), 64, 100)  # fewer shards than the run before
    assert [f.name for f in folder.glob("*.bin")] == [shard_name(0)] and (folder / "notes.txt").exists()
    assert [s for s, _ in read_slots(str(folder))] == list(range(6))


def test_the_permutation_is_a_feistel_network():
    """Against one value at a time in plain integers."""
    from rastertime.llm.feistel_order import ROUNDS, permuted

    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def slot(i, n, key):
        half = 1
        while 4**half < n:
            half += 1
        while True:
            left, right = i >> half, i & (1 << half) - 1
            for r in range(1, ROUNDS + 1):
                left, right = right, left ^ (mix(right ^ mix(key + r * 0x9E3779B97F4A7C15 & mask)) & (1 << half) - 1)
            i = left << half | right
            if i < n:
                return i

    for n, key in ((1, 0), (5, 9), (777, 3), (1 << 20, 12345)):
        at = np.arange(0, n, max(1, n // 50))
        assert permuted(at, n, key).tolist() == [slot(int(i), n, key) for i in at]


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation_is_one_to_one(n):
    from rastertime.llm.feistel_order import permuted

    got = permuted(np.arange(n), n, 3)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 64 or (permuted(np.arange(n), n, 4) != got).any()


def test_benchmark_copies_against_full_alignment(spark, duck, docs):
    from rastertime.llm.seed_align import LEAST, align, item_words
    from rastertime.llm.text import WordHashes

    h = WordHashes()
    items = [(i, h.of(item_words(t))) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    got = {(r.doc_id, r.item_id): r.similarity for r in Q.QUERIES["op10_seed_align"](spark, SF).collect()}
    want = {}
    for i, t in docs:
        w = h.of(item_words(t or ""))
        if len(w) > 3000:
            continue
        for k, item in items:
            if np.isin(item, w).mean() >= LEAST:  # fewer can't score that
                s = align(w, item)[0] / len(item)
                if s >= LEAST:
                    want[i, k] = s
    short = {i for i, t in docs if len(item_words(t or "")) <= 3000}
    assert {k for k in got if k[0] in short} == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pipeline(spark, docs):
    import corpus_pipeline as P

    spark_docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = spark_docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    before = {i for i, _ in docs}
    at = spark_docs
    for name, stage in P.STAGES:
        at = stage(spark, at, SF)
        ids = [r.doc_id for r in at.select("doc_id").collect()]
        assert set(ids) <= before
        if name != "sharding":
            assert at.columns == cols
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert len(ids) == len(set(ids)) and len(ids) >= 0.5 * len(before)
        if name == "mixing":
            assert max(Counter(ids).values()) <= 3
        before = set(ids)
        if name != "sharding":
            from rastertime.llm.base import materialise

            at = materialise(at)
    got = at.collect()
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
