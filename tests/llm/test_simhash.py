"""SimHash against hashes and distances written out."""

import random

import numpy as np
import xxhash

from rastertime.llm import simhash
from rastertime.llm.base import materialise, release
from tests.llm.util import empty, frame, odd


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_fingerprints_and_groups_of_texts(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(1, "One"), (2, "one"), (3, "a b"), (4, "ÀB cd É"), (5, None), (6, " \t"), (7, ""), (8, "x y z x y z x y z")]
    rows += [(100 - k, " ".join([*base[: 9 * k], "Edit", *base[9 * k + 1 :]])) for k in range(1, 40)]
    rows += [(200 + k, " ".join(f"u{rng.randrange(900)}" for _ in range(60))) for k in range(60)]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    want = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    links = [(a, b) for a in want for b in want if a < b and bin(want[a] ^ want[b]).count("1") <= 3]
    assert {i: r.component_id for i, r in got.items()} == reach(want, links)
    assert len({r.component_id for i, r in got.items() if 60 < i < 100}) < 30


def test_hash_is_that_of_spark(spark):
    texts = ["", "a", "abcdefgh", "ab cd ef gh ij", "ß é 🙂 " * 9]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) AS h").collect()
    assert [r.h % 2**64 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def clusters(rng, centres, members, most):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            x = c
            for b in rng.sample(range(64), rng.randrange(most + 1)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def check_groups(spark, fps):
    signed = np.array(fps, np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in signed], "id long")
    got = {r.id: r.component for r in simhash.linked(nodes).collect()}
    x = signed.view(np.uint64)
    links = [(int(signed[i]), int(signed[j])) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3) if j > i]
    want = reach([int(i) for i in signed], links)
    assert {int(i): got.get(int(i), int(i)) for i in signed} == want


def test_every_link_of_clusters_counts(spark, monkeypatch):
    rng = random.Random(11)
    check_groups(spark, clusters(rng, 25, 30, 6))
    chain = [0]
    for k in range(60):  # each is three bits from the one before, in any segment
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 3)))
    check_groups(spark, sorted(set(chain)))
    monkeypatch.setattr(simhash, "SIDE", 16)  # one long list, over many blocks
    fixed = rng.getrandbits(32)
    check_groups(spark, sorted({fixed << 32 | x & 0xFFFFFFFF for x in clusters(rng, 6, 40, 5)}))


def test_no_pairs_leave_a_group(spark):
    ball = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    signed = np.array(ball, np.uint64).view(np.int64)
    lists = spark.createDataFrame([(7, len(ball), int(x), True, int(x)) for x in signed], "list long, n long, id long, exact boolean, component long")
    found = simhash.block_links(lists).count()
    blocks = -(-len(ball) // simhash.SIDE)
    assert len(ball) - 1 <= found <= len(ball) * blocks


def test_postings_are_never_broadcast(spark):
    nodes = materialise(spark.range(2000).selectExpr("xxhash64(id) AS id"))  # 34 times as many postings, sized as the nodes
    plan = simhash.tables(nodes)._jdf.queryExecution().executedPlan().toString()
    release(nodes)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_edges(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    rows = odd(spark).selectExpr("*", "doc_id * 0 AS fp").withColumnRenamed("lang", "component")
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[5] == of[6] == 5 and of[4] == 4 and of[None] is None
