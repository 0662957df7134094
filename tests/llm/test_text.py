"""Properties of the text primitives."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rastertime.llm.minhash_join import linked, signature, spanning
from rastertime.llm.nb_linear import hashes, ngrams
from rastertime.llm.seed_align import align
from rastertime.llm.spotsigs import likeness, spots
from rastertime.llm.text import WordHashes, shingle_set, words

TEXT = st.text(st.characters(codec="utf-8"), max_size=200)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_pattern(t):
    assert [w.decode() for w in words(t)] == re.findall(r"[^\x20\x09-\x0D]+", lower(t))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30))
def test_shingles_are_as_many_as_distinct_runs(w):
    got = shingle_set(WordHashes().of([x.encode() for x in w]))
    want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    assert len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=8))
def test_links_against_sets(sets):
    got = linked([np.array(sorted(s), np.uint64) for s in sets], 60)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == (100 * len(a & b) >= 60 * len(a | b))
    names = np.arange(len(sets))
    edges = spanning(got, names)
    assert len(edges) < len(sets) and all(b < a for a, b in edges)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    same = [(signature(a) == signature(np.concatenate([a[:k], rng.integers(0, 2**63, 1000 - k).astype(np.uint64)]))).mean() for k in (1000, 900, 500, 0)]
    assert same[0] == 1 and same[0] > same[1] > same[2] > same[3] == 0


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_fingerprints_and_ngrams_are_sorted_sets(t):
    for x in (spots(t), ngrams(t)):
        assert (np.diff(x.astype(np.int64)) > 0).all()
    assert likeness(spots(t), spots(t)) == 1
    assert set(ngrams(t).tolist()) == {int(v) for h in hashes(t) for v in h}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=8))
def test_alignment_against_the_full_table(doc, item):
    h = np.zeros((len(item) + 1, len(doc) + 1))
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -0.25), h[i - 1, j] - 0.25, h[i, j - 1] - 0.25)
    score, start, end = align(np.array(doc, np.uint64), np.array(item, np.uint64))
    assert abs(score - h.max()) < 1e-12 and 0 <= start <= end <= len(doc)
