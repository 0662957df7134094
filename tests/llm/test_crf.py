"""The skip-chain field against exact enumeration, and spans that only skip edges add."""

import itertools

import numpy as np
import pytest

from rastertime.llm.skip_chain_crf import CODES, KINDS, LABELS, Graph, SkipChain, base_spans, find, graph, shown, similar, together, train
from tests.llm.util import frame

K = len(LABELS)


def model(rng, strength=1.0, skip=1.5):
    return SkipChain(rng.normal(0, strength, (CODES, K)), rng.normal(0, strength, (K, K)), skip)


def exact(m, g):
    n, out = len(g.spans), np.zeros((len(g.spans), K))
    for labels in itertools.product(range(K), repeat=n):
        if any(s and s != y for s, y in zip(g.seen, labels)):
            continue
        z = sum(0 if s else m.node[c, y] for s, c, y in zip(g.seen, g.codes, labels))
        z += sum(m.chain[labels[a], labels[b]] for a, b in g.chain) + sum(m.skip * (labels[a] == labels[b]) for a, b in g.skip)
        for i, y in enumerate(labels):
            out[i, y] += np.exp(z)
    return out / out.sum(axis=1, keepdims=True)


def made(n, chain, skip, seen, rng):
    two = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph([(3 * i, 3 * i + 2) for i in range(n)], rng.integers(0, CODES, n), np.array(seen), two(chain), two(skip))


@pytest.mark.parametrize("seed", range(6))
def test_trees_are_exact(seed):
    rng = np.random.default_rng(seed)
    n = 2 + seed % 5
    chain = [(i, i + 1) for i in range(n - 1) if rng.random() < 0.6]
    skip = [(i, i + 1) for i in range(n - 1) if (i, i + 1) not in chain]
    g = made(n, chain, skip, [int(rng.integers(K)) if rng.random() < 0.4 else 0 for _ in range(n)], rng)
    m = model(rng)
    assert np.abs(m.beliefs(g) - exact(m, g)).max() < 2e-3


@pytest.mark.parametrize("seed", range(4))
def test_loops_are_near_exact(seed):
    rng = np.random.default_rng(seed)
    g = made(5, [(0, 1), (1, 2), (3, 4)], [(0, 3), (2, 4)], [0, 2, 0, 0, 0], rng)
    m = model(rng, 0.7, 1.0)
    got, want = m.beliefs(g), exact(m, g)
    assert np.abs(got - want).max() < 0.05


def test_documents_do_not_touch_one_another():
    rng = np.random.default_rng(1)
    m = model(rng)
    graphs = [made(n, [(i, i + 1) for i in range(n - 1)], [(0, n - 1)] if n > 2 else [], [1] + [0] * (n - 1), rng) for n in (1, 3, 6, 2)]
    whole, of = together(graphs)
    alone = np.concatenate([m.beliefs(g) for g in graphs])
    assert np.abs(m.beliefs(whole, of) - alone).max() < 1e-12


def one_apart(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_similar_tokens_are_joined():
    rng = np.random.default_rng(0)
    for _ in range(30):
        first = "".join(rng.choice(list("ab1@."), 9))
        cores = [first]
        for _ in range(8):
            x, k = cores[int(rng.integers(len(cores)))], int(rng.integers(8))
            cores.append(x[:k] + str(rng.choice(["", "a", "1", "b9"])) + x[k + int(rng.integers(2)) :])
        links = similar(cores, [""] * len(cores))
        root = list(range(len(cores)))
        for _ in cores:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        for i, a in enumerate(cores):
            for j, b in enumerate(cores):
                if len(a) >= 8 and len(b) >= 8 and one_apart(a, b):
                    assert root[i] == root[j], (a, b)


def test_only_skip_edges_add_these_spans(spark):
    texts = [f"call +1 555 {k:03d} 4567 today or +1 555 {k:03d} 4567 soon. Later on ask 555-{k:03d}-4567 again" for k in range(100, 130)]
    texts += [f"order 20{k} of the day has {k} parts" for k in range(100, 130)]
    m = train(frame(spark, list(enumerate(texts))))
    bases = [base_spans(t) for t in texts]
    got = [shown(x) for x in m.added(texts, bases)]
    at = texts[0].index("555-100")
    assert got[0] == f"phone:{at}:{at + 12}" and all(x.startswith("phone") for x in got[:30]) and not any(got[30:])
    apart = SkipChain(m.node, m.chain, 0.0)
    assert not any(apart.added(texts, bases))
    rows = {r.doc_id: r for r in find(frame(spark, [(7, texts[0]), (8, None)]), m).collect()}
    assert rows[7].n_phone == 2 and rows[7].spans.count("phone") == 3 and rows[8].spans == ""


def test_many_spans_over_one_token():
    text = "x " + "1.2.3.4" * 40 + "@a.b " + "1.2.3.4"
    base = base_spans(text)
    g = graph(text, base)
    assert {KINDS[k - 1] for k in g.seen if k} == {"email", "ip"}
    for a, b in [s for s, k in zip(g.spans, g.seen) if not k]:
        assert not any(x < b and y > a for _, x, y in base)
