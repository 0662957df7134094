"""Copies of benchmark items against full alignment of every pair, under edits of every rate."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rastertime.llm import seed_align
from rastertime.llm.seed_align import LEAST, copies, decontaminate, item_words
from tests.conftest import SF
from tests.llm.util import frame


def edited(words, rate, rng, kinds):
    out = []
    for w in words:
        kind = rng.choice(kinds) if rng.random() < rate else "same"
        out += {"same": [w], "other": [f"x{rng.integers(1000)}"], "gone": [], "more": [w, f"y{rng.integers(1000)}"]}[kind]
    return out


@pytest.mark.parametrize("n", [15, 25, 40, 59])
def test_every_fifth_word_replaced(spark, n):
    item = [f"w{k}" for k in range(n)]
    text = " ".join(f"x{k}" if k % 5 == 4 else w for k, w in enumerate(item))
    docs = frame(spark, [(1, f"before it {text} after it"), (2, " ".join(f"z{k}" for k in range(n)))])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = copies(docs, bench).first()
    assert (got.doc_id, got.item_id) == (1, 7) and 0.7 < got.similarity < 0.8
    assert [r.doc_id for r in decontaminate(docs, bench).collect()] == [2]


def test_a_copy_is_found_by_a_common_passage(spark):
    item = [f"w{k}" for k in range(20)]
    part = " ".join(item[:9])
    with_edits = " ".join(f"x{k}" if k in (9, 13, 17) else w for k, w in enumerate(item))
    docs = frame(spark, [(1, with_edits), (2, " ".join(item)), *[(k, f"{part} only {k}") for k in range(3, 60)]])
    got = copies(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


def smith_waterman(doc, item):
    """The best local score by the full table, cell by cell."""
    before, best = [0.0] * (len(doc) + 1), 0.0
    for w in item:
        row = [0.0]
        for j, d in enumerate(doc, 1):
            row.append(max(0.0, before[j - 1] + (1.0 if d == w else -0.25), before[j] - 0.25, row[-1] - 0.25))
        best, before = max(best, max(row)), row
    return best


def test_nothing_is_lost_against_full_alignment(spark):
    rng = np.random.default_rng(5)
    kinds = [["other"], ["gone"], ["more"], ["other", "gone", "more"]]
    items = [[f"w{rng.integers(200 if rng.random() < 0.7 else 4)}" for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 9, 12, 15, 25, 40, 59)]
    docs = [[f"w{rng.integers(200)}" for _ in range(300)]]
    for k in range(140):
        pad = [f"w{rng.integers(200)}" for _ in range(int(rng.integers(0, 250)))]
        docs.append([*pad, *edited(items[k % len(items)], rng.choice([0.05, 0.2, 0.3, 0.4, 0.9]), rng, kinds[k % 4]), *pad[:50]])
    docs.append([w for i in items for w in [*i, *(f"z{k}" for k in range(1500))]])  # longer than a passage
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in copies(frame(spark, [(k, " ".join(d)) for k, d in enumerate(docs)]), bench).collect()}
    want = {}
    for k, d in enumerate(docs):
        for j, i in enumerate(items):
            if len(set(i) & set(d)) and (k < 60 or k == len(docs) - 1 or j == (k - 1) % len(items)):  # the rest would take long
                want[k, j] = smith_waterman(d, i) / len(i)
    near = {p for p, s in want.items() if s >= LEAST}
    assert near == {p for p in got if p in want} and len(near) > 100
    assert all(abs(got[p] - want[p]) < 1e-9 for p in near)


def test_recall_of_edited_copies(spark):
    """Items of the test tables with words replaced at random, each in a text of its own."""
    rng = np.random.default_rng(3)
    folder = SF.replace("sf0.001", "sf0.01")
    items = [(r.item_id, item_words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = []
    for rate in (0, 10, 20, 25, 30):
        for i, w in items:
            text = " ".join(f"x{rng.integers(10**6)}" if rng.random() * 100 < rate else x for x in w)
            rows.append((rate * 1000 + len(rows) % len(items), f"some words before {text} and after"))
    got = {r.doc_id for r in copies(frame(spark, rows), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    share = {rate: sum(d // 1000 == rate for d in got) / len(items) for rate in (0, 10, 20, 25, 30)}
    print(share)
    assert share[0] == 1 and share[10] == 1 and min(share.values()) >= 0.9


def test_hashes_are_of_the_same_words(monkeypatch):
    rng = np.random.default_rng(9)
    signs = list("ab1_ -.\n\x1c\x85 éßİΣσς²½Ⅷ一三𝔘🙂́")
    texts = ["", "ΑΣ", "Σ", "_", "İİ x", "w" * 300, *("".join(rng.choice(signs, rng.integers(0, 90))) for _ in range(400))]
    for piece in (1, 7, 64, seed_align.PIECE):  # texts are cut between words into pieces of so many code points
        monkeypatch.setattr(seed_align, "PIECE", piece)
        of = {}
        for first, end in seed_align.portions(texts):
            words, bounds = seed_align.hashed(texts[first:end])
            for t, a, b in zip(texts[first:end], bounds, bounds[1:]):
                assert len(item_words(t)) == b - a
                assert all(of.setdefault(w, h) == h for w, h in zip(item_words(t), words[a:b].tolist()))
            assert len(words) == bounds[-1]
        assert len(set(of.values())) == len(of) > 500
    assert [len(x) for x in seed_align.hashed([])] == [0, 1]


def test_passages_are_those_of_each_text_alone():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, n)) for n in (0, 1, 2, 3, 0, 50, 400, 3000, 1, 7)]
    item = seed_align.seeds_of(seed_align.hashed(["w1 w2 w3 w4 w5 w6 w7"])[0], 1)
    table = np.zeros(1 << 16, bool)
    table[(item & np.uint64(len(table) - 1)).astype(np.int64)] = True
    for by_word in (False, True):
        alone = [(k, *r) for k, t in enumerate(texts) for r in (x[1:] for x in seed_align.runs(*seed_align.hashed([t]), table, by_word, 2, 12))]
        words, bounds = seed_align.hashed(texts)
        together = [(k, a - bounds[k], b - bounds[k], s, at - bounds[k]) for k, a, b, s, at in seed_align.runs(words, bounds, table, by_word, 2, 12)]
        assert len(alone) == len(together) > 3
        for x, y in zip(alone, together):
            assert x[:3] == y[:3] and (x[3] == y[3]).all() and (x[4] == y[4]).all()


def test_hashing_words_takes_less_than_finding_them():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"wörd{i}" for i in rng.integers(0, 10**6, 400)) for _ in range(1500)]
    seed_align.hashed(texts[:1])  # tables

    def took(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    found = min(took(lambda: [item_words(t) for t in texts]) for _ in range(3))
    assert min(took(lambda: [seed_align.hashed(texts[a:b]) for a, b in seed_align.portions(texts)]) for _ in range(3)) < found


def peak_of(run):
    """What a generator of batches gives, and the MB of Python's objects and of a batch that it needed at most."""
    tracemalloc.start()
    out, largest = [], 0
    for batch in run():
        largest = max(largest, batch.nbytes)
        out.append(batch)
    held = sum(b.nbytes for b in out)  # Arrow's memory, which tracemalloc doesn't see
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held > 0
    return pa.Table.from_batches(out), peak / 1e6, largest / 1e6


def test_a_task_holds_a_slice_of_a_batch_as_objects(monkeypatch):
    """Batches have up to 10,000 rows: as objects all at once, with all their passages, they took hundreds of MB of a worker."""
    rng = np.random.default_rng(6)
    item = " ".join(f"item{k}" for k in range(40))
    pads = [" ".join(f"pad{i}" for i in rng.integers(0, 10**6, 350)) for _ in range(50)]
    texts = [None if k % 97 == 0 else f"{pads[k % 50]} {item} {k} {pads[k * 7 % 50]}" for k in range(1500)]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([None if k % 5 == 0 else 2**53 + k for k in range(len(texts))], pa.int64()), "text_hash": pa.array(range(len(texts)), pa.int64()), "text": texts})
    words = seed_align.hashed([item])[0]
    need, matches, width = seed_align.kept(len(words), LEAST)
    table = np.zeros(1 << 16, bool)
    table[(seed_align.seeds_of(words, need) & np.uint64(len(table) - 1)).astype(np.int64)] = True
    seed_align.hashed(pads)  # tables
    monkeypatch.setattr(seed_align, "SLICE", 1 << 18)

    def passages():
        return peak_of(lambda: seed_align.passages_in(iter([docs.slice(0, 0), docs]), 5 << 40, table, False, need, width))

    found, peak, largest = passages()
    assert found.schema == seed_align.FOUND and set(found["row"].to_pylist()) == {(5 << 40) + k for k, t in enumerate(texts) if t}
    assert all(i is None if r % 5 == 0 else i == 2**53 + r for r, i in zip((r - (5 << 40) for r in found["row"].to_pylist()), found["doc_id"].to_pylist()))
    some = found.slice(0, 600)
    n = some.num_rows
    pairs = some.append_column("item", pa.array([3] * n, pa.int64())).append_column("item_id", pa.array([7] * n, pa.int64())).append_column("item_words", pa.array([words.tobytes()] * n, pa.binary()))
    for name, value in (("need", need), ("matches", matches), ("width", width)):
        pairs = pairs.append_column(name, pa.array([value] * n, pa.int64()))
    pairs = pairs.combine_chunks().to_batches()[0]

    def scores():
        return peak_of(lambda: seed_align.scores_in(iter([pairs]), LEAST))

    scored, score_peak, _ = scores()
    assert scored["similarity"].to_pylist() == [1.0] * n and scored["row"] == some["row"] and scored["doc_id"] == some["doc_id"]
    monkeypatch.setattr(seed_align, "SLICE", 1 << 40)  # a whole batch at once, as before
    whole, whole_peak, whole_largest = passages()
    whole_scored, whole_score_peak, _ = scores()
    assert whole == found and whole_scored == scored
    print(peak, largest, score_peak, "at once", whole_peak, whole_largest, whole_score_peak, "of", docs.nbytes / 1e6, pairs.nbytes / 1e6)
    assert peak < 0.6 * whole_peak and 10 * largest < whole_largest
    assert score_peak < 0.4 * whole_score_peak


def test_large_ids_stay_beside_null_ones(spark):
    item = " ".join(f"w{k}" for k in range(20))
    ids = [None, *(2**60 + k for k in range(1, 8, 2))]
    docs = frame(spark, [(i, f"before {item} after") for i in ids]).coalesce(1)  # a batch of both
    bench = spark.createDataFrame([(i, item) for i in ids], "item_id long, text string").coalesce(1)
    got = copies(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in ids for i in ids} and len(got) == 25
    assert decontaminate(docs, bench).count() == 0
