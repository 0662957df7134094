"""The whole query of op2 against chains, likeness and edited texts written out."""

import hashlib
import random

import xxhash

from rastertime.llm import spotsigs
from tests.llm.util import frame


def plain_spots(text):
    words, now = [], ""
    for ch in [*text.lower(), " "]:
        if ch.isalpha():
            now += ch
        elif now:
            words.append(now)
            now = ""
    chains = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:3]
            if len(after) == 3:
                chains.add(" ".join([w, *after]))
    if not chains:
        chains = {" ".join(words[i : i + 4]) for i in range(len(words) - 3)}
    if not chains:
        chains = {"\0" + " ".join(words) if words else "\1" + text}
    return {xxhash.xxh32_intdigest(c) for c in chains}


def shown(s):
    return "".join(f"{x:08x}" for x in sorted(s))


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_the_query_by_hand(spark):
    rng = random.Random(4)
    words = ["the", "of", "und", "la", "que", "forest", "River", "Straße", "año", "mountain", "light", "x1", "winter", "été"]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(1, 60))) + rng.choice([".", " !", "\n"])) for i in range(60)]
    rows += [(1, None), (2, ""), (4, "the of und"), (5, "one two three four five six"), (7, "...")]
    rng.shuffle(rows)
    in_order = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    want = {}
    for k, (i, t) in enumerate(in_order):
        after = in_order[(k + 1) % len(in_order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        own, new, following = plain_spots(t), plain_spots(edited), plain_spots(after)
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(new), likeness(own, new), likeness(own, following))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in spotsigs.compare_with_edited(frame(spark, rows)).collect()}
    assert got == want


def test_groups_by_partitions_of_length(spark):
    """Links of the partitioned, pruned search against the likeness of all pairs."""
    rng = random.Random(9)
    vocabulary = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    base = [w for _ in range(80) for w in (rng.choice(["the", "of", "and"]), *rng.choices(vocabulary, k=2))]
    rows = []
    for i in range(80):
        text = list(base) if i % 2 else [w for _ in range(60) for w in (rng.choice(["the", "of"]), *rng.choices(vocabulary, k=2))]
        for _ in range(rng.randrange(8)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(x.replace("w", "w") for x in text)))
    sets = {i: plain_spots(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and likeness(sets[a], sets[b]) >= 0.8:
                    root[b], changed = root[a], True
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(frame(spark, rows), 80).collect()}
    assert got == root and 20 < len(set(root.values())) < 80
