"""The trie join against plain edit distances."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastertime.llm import op13, trie_join
from tests.compare import same
from tests.conftest import SF
from tests.llm.util import empty, frame, odd


def at_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(n):
    out, form = {}, {}
    for w in n:
        near = [x for x in n if at_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [len(near), n.get(form[w])]
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], *out[w])
    return sorted(out.values())


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@given(st.sets(st.text("abé", max_size=6), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_active_nodes_are_those_at_distance_one(words):
    words = sorted(words)
    got = trie_join.near_nodes(words)
    for i, w in enumerate(words):
        assert sorted(got[i]) == [j for j, x in enumerate(words) if at_one(w, x)]


@pytest.mark.parametrize("size", [2000, 3])
def test_every_pair_is_in_one_partition(spark, monkeypatch, size):
    """Partitions of any size, also those split down to one character, give what plain distances give."""
    monkeypatch.setattr(trie_join, "WORDS", size)
    rng = random.Random(size)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(150)} | {"prefix" + "".join(rng.choice("xyz") for _ in range(3)) + "suffix" for _ in range(25)} | {"ünd", "und", "undé", "a" * 300, "a" * 299 + "b", "a" * 301}
    n = {w: rng.choice([3, 3, 4, 6, 7, 12, 30]) for w in sorted(words)}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(trie_join.variants(vocabulary)) == plain_variants(n)


def test_words_and_typos_of_texts(spark):
    rng = random.Random(1)
    words = ["Überall", "ÜBERALL", "straße", "Naïve", "coming", "comming", "abcde", "Čeština", "x×y÷z", "sœur", "word's", "tiny", "a" * 2000]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(60)] + [(60, None), (61, ""), (None, "coming comming ...")]
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if k >= 3 and len(w) >= 5}
    assert any(len(w) == 1999 for w in n) and "übera" not in n
    assert rows_of(trie_join.spelling_groups(frame(spark, rows))) == plain_variants(n)


def test_edges(spark):
    assert trie_join.spelling_groups(empty(spark)).count() == 0
    rows = odd(spark).selectExpr("*", "'x' AS word", "'y' AS run", "1 AS n", "2 AS m")
    assert [r.n for r in trie_join.spelling_groups(rows).where("word = 'word'").collect()] == []
    many = spark.createDataFrame([("words", 3), ("wordx", 6), ("wordy", 6), ("wordyz", 12), ("wordyzz", 24)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in trie_join.variants(many).collect()}
    assert got["words"] == ("wordx", "wordx") and got["wordy"] == ("wordyz", "wordyzz")


@pytest.mark.parametrize("sf", [SF])
def test_query_matches_sql(spark, duck, sf):
    same(op13.query(spark, sf), duck, op13.ORACLE)
