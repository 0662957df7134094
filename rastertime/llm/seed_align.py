"""Benchmark decontamination: rare pairs of words join passages of documents to items, Smith-Waterman alignment scores them.

1. An item's seeds are its pairs of neighbouring words (its words, where it is so short that a copy need not keep a pair).
   All seeds set bits of a table of fixed size, which tasks use to tell most other words of the documents from seeds.
2. Passages are runs of words around places where seeds begin, no further apart than the longest copy is wide; a run with
   fewer seeds than any copy keeps is dropped. Only these runs leave the pass over the documents, as hashes.
3. Seeds are counted over all passages. Of its p seeds, of which every copy keeps k, an item posts the p - k + JOINED that
   fewest passages have: a copy must hit JOINED of them. The commoner seeds are never joined.
4. Passages join items by these rare seeds; pairs with JOINED hits, with k seeds in all and with as many of the item's
   words as a copy keeps are aligned in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastertime.llm.base import attach, materialise, release, unused
from rastertime.llm.text import MIX, mixed

#: A pair of neighbouring item words is found in a document with at most so many words less one between them.
REACH = 3
MATCH, MISMATCH, GAP = 1.0, -0.25, -0.25
#: Share of an exact copy's score from which a stretch counts as a copy: two fifths of its words may be others.
LEAST = 0.5
#: Rare seeds that a passage and an item must share, bits of the table of seeds (as a power of two), words of a passage at
#: most (or four widths of the longest copy), ids and bytes of item words that are broadcast at most.
JOINED, BITS, PASSAGE, IDS, BYTES = 8, 26, 1024, 1_000_000, 64 << 20
#: Code points that are hashed at once, the odd base of word hashes, and items that a task remembers.
PIECE, BASE, ITEMS = 1 << 18, 0xD6E8FEB86659FD93, 10_000
#: Bytes of an Arrow batch that a task turns into objects at once, and of passages that it puts out at once, about.
SLICE = 2 << 20
ITEM = pa.schema({"item": pa.int64(), "item_id": pa.int64(), "words": pa.binary(), "seeds": pa.list_(pa.int64()), "need": pa.int64(), "matches": pa.int64(), "width": pa.int64(), "by_word": pa.bool_()})
FOUND = pa.schema({"passage": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "start": pa.int64(), "words": pa.binary(), "seeds": pa.list_(pa.int64()), "places": pa.list_(pa.int32())})
SCORED = pa.schema({"row": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "item": pa.int64(), "item_id": pa.int64(), "similarity": pa.float64(), "first_word": pa.int64(), "last_word": pa.int64()})
_WORD, _GAP = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")


def item_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@cache
def letters() -> np.ndarray:
    """A number for each code point that words are made of, 0 for all others."""
    out = np.zeros(0x110000, np.uint64)
    for m in _WORD.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = mixed(np.arange(m.start() + 1, m.end() + 1, dtype=np.uint64) * MIX)
    return out


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (see ``item_words``) of texts, one after another, and the place of each text's first, and the end.

    A word's hash is the sum of its letters' numbers times powers of BASE by their place, modulo 2^64. Sums run over many
    words at once, in pieces cut between words.
    """
    lower = [t.lower() for t in texts]
    text, at, words, starts = "\n".join(["", *lower, ""]), 0, [], []
    while at < len(text) - 1:
        gap = _GAP.search(text, min(at + PIECE, len(text) - 1)).start()
        number = letters()[np.frombuffer(text[at : gap + 1].encode("utf-32-le", "surrogatepass"), "<u4")]
        edges = np.flatnonzero(np.diff(number != 0)).reshape(-1, 2)  # last gap before and last letter of each word
        n = 1 << max(PIECE, len(number)).bit_length()
        sums = np.cumsum(number * powers(BASE, n)[: len(number)])
        words.append(mixed((sums[edges[:, 1]] - sums[edges[:, 0]]) * powers(pow(BASE, -1, 1 << 64), n)[edges[:, 0]]))
        starts.append(edges[:, 0] + at)
        at = gap
    bounds = np.cumsum([0, *(len(t) + 1 for t in lower)])
    return np.concatenate(words or [np.zeros(0, np.uint64)]), np.searchsorted(np.concatenate(starts or [bounds[:0]]), bounds)


def portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about PIECE code points together, one at least: first, and end."""
    first = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t)
        if size >= PIECE or k == len(texts):
            yield first, k
            first, size = k, 0


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of about SLICE bytes together, one at least, without copying them."""
    for batch in batches:
        n = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
        for first in range(0, batch.num_rows, n):
            yield batch.slice(first, n)


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of numbers of a column, as parts of its memory."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows, one at least, whose lists are arrays."""

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)], dtype=np.int32), pa.array(np.concatenate(values), kind.value_type))

    return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of an item in a stretch of words: its score, and start and end (exclusive) in the stretch."""
    n = len(doc)
    at = np.arange(n + 1)
    h, since = np.zeros(n + 1), at.copy()  # score and where its alignment began, at each end
    best = (0.0, 0, 0)
    for w in item:
        up = h + GAP
        across = np.concatenate([[0.0], h[:-1] + np.where(doc == w, MATCH, MISMATCH)])
        new = np.maximum(np.maximum(up, across), 0.0)
        origin = np.where(across >= up, np.concatenate([[0], since[:-1]]), since)
        origin = np.where(new > 0, origin, at)
        slid = np.maximum.accumulate(new - GAP * at) + GAP * at  # words of the document that the item lacks
        src = np.maximum.accumulate(np.where(new - GAP * at >= np.maximum.accumulate(new - GAP * at), at, 0))
        origin = np.where(slid > new, origin[src], origin)
        h, since = np.maximum(slid, 0.0), origin
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (float(h[j]), int(since[j]), j)
    return best


def kept(n: int, least: float) -> tuple[int, int, int]:
    """What every alignment of an n-word item with a score of ``least`` * n has: found pairs of neighbours at least, words
    that match at least, and words of the document at most.

    Another or a missing word costs a match and a penalty and breaks two pairs; REACH added words between two neighbours
    break one; words left out at an end cost a match and break a pair each.
    """
    spare = (MATCH - least) * n + 1e-9
    pair = min((MATCH - max(MISMATCH, GAP)) / 2, -GAP * REACH, MATCH)
    return n - 1 - int(spare / pair), max(1, n - int(spare / MATCH)), n + int(spare / -GAP)


def pair_hashes(words: np.ndarray, reach: int) -> list[np.ndarray]:
    """For each distance up to ``reach``, a hash of each word and the word at that distance after it."""
    first = mixed(words) * MIX
    return [mixed(first[:-d] + words[d:]) for d in range(1, min(reach, len(words) - 1) + 1)]


def seeds_of(words: np.ndarray, pairs: int) -> np.ndarray:
    """A seed for each place of an item."""
    if not len(words):
        return words
    return pair_hashes(words, 1)[0] if pairs > 0 else mixed(words)


def items_of(benchmark: DataFrame, least: float) -> DataFrame:
    """(item, item_id, words, seeds, need, matches, width): a row per item with words; item numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            items, ids, texts = (batch.column(c).to_pylist() for c in ("item", "item_id", "text"))
            texts = [t or "" for t in texts]
            for first, end in portions(texts):
                words, at = hashed(texts[first:end])
                for item, item_id, a, b in zip(items[first:end], ids[first:end], at.tolist(), at[1:].tolist()):
                    if b > a:
                        w = words[a:b]
                        pairs, matches, width = kept(len(w), least)
                        out.append((item, item_id, w.tobytes(), seeds_of(w, pairs).view(np.int64), pairs if pairs > 0 else matches, matches, width, pairs < 1))
            if out:
                yield record(out, ITEM)

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item long, item_id long, words binary, seeds array<long>, need long, matches long, width long, by_word boolean")


def seed_table(items: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, table): 2^bits bits, of which the last bits of each seed set one; 256 for each seed, but 2^BITS at most, so
    no more numbers than the table has reach the driver."""
    seeds = items.select(F.explode("seeds").alias("seed"))
    bits = min(BITS, max(16, (256 * seeds.agg(F.approx_count_distinct("seed")).first()[0]).bit_length()))
    at = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    got = seeds.groupBy(F.shiftright(at, 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(seed & 31 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), "<u4")
    table[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return bits, table


def unpacked(table: np.ndarray) -> np.ndarray:
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def runs(words: np.ndarray, bounds: np.ndarray, table: np.ndarray, by_word: bool, low: int, width: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(text, start, end, seeds, their places) of the passages that may hold a copy of some item.

    ``bounds`` are the places of the texts' first words, and the end. All places count from the first text's first word.
    """
    at, found = [], []
    for d, g in [*enumerate(pair_hashes(words, REACH), 1), *([(0, mixed(words))] if by_word else [])]:
        p = np.flatnonzero(table[(g & np.uint64(len(table) - 1)).view(np.int64)])
        p = p[p + d < bounds[np.searchsorted(bounds, p, "right")]]  # both words in one text
        at.append(p)
        found.append(g[p])
    if not at or not sum(map(len, at)):
        return
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    at, found = at[order], found[order]
    text = np.searchsorted(bounds, at, "right") - 1
    long = max(PASSAGE, 4 * width)
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) > width) | (np.diff(text) > 0)) + 1, [len(at)]])
    enough = np.flatnonzero(np.diff(cuts) >= low)
    for a, b in zip(cuts[enough].tolist(), cuts[enough + 1].tolist()):
        k = int(text[a])
        start, end = max(int(bounds[k]), int(at[a]) - width), min(int(bounds[k + 1]), int(at[b - 1]) + width + REACH)
        for begin in range(start, max(start + 1, end - width), long - width):
            stop = min(end, begin + long)
            x, y = np.searchsorted(at, [begin, stop]).tolist()
            if y - x >= low:
                yield k, begin, stop, found[x:y], at[x:y]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def places_in(own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted ``own``, and at which place."""
    k = np.minimum(np.searchsorted(own, values), len(own) - 1)
    mine = own[k] == values
    return mine, k[mine]


def regions(at: np.ndarray, seeds: np.ndarray, own: np.ndarray, times: np.ndarray, need: int, width: int) -> list[tuple[int, int]]:
    """Where in a text a copy of an item may lie: ``width`` words with ``need`` of its seeds, places ``at`` in order.

    ``own`` are the item's distinct seeds in order, ``times`` how many of its places each stands for.
    """
    mine, k = places_in(own, seeds)
    has = np.zeros(len(own), bool)
    has[k] = True
    if times[has].sum() < need:
        return []
    at, k, times = at[mine].tolist(), k.tolist(), times.tolist()
    inside, points, left = [0] * len(own), 0, 0
    out: list[tuple[int, int]] = []
    for p, i in zip(at, k):
        inside[i] += 1
        points += times[i] if inside[i] == 1 else 0
        while p - at[left] > width:
            inside[k[left]] -= 1
            points -= times[k[left]] if not inside[k[left]] else 0
            left += 1
        if points >= need:
            a, b = p - width, at[left] + width + REACH
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def passages_in(batches: Iterator[pa.RecordBatch], row: int, table: np.ndarray, by_word: bool, low: int, width: int) -> Iterator[pa.RecordBatch]:
    """The passages of rows (doc_id, text_hash, text), of which ``row`` is the number of the first, in batches of FOUND."""
    passage = row - 1
    for batch in slices(batches):
        ids, hashes, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))
        texts, out, size = [t or "" for t in texts], [], 0
        for first, end in portions(texts):
            w, bounds = hashed(texts[first:end])
            for k, a, b, s, at in runs(w, bounds, table, by_word, low, width):
                passage += 1
                out.append((passage, row + first + k, ids[first + k], hashes[first + k], a - bounds[k], w[a:b].tobytes(), s.view(np.int64), (at - bounds[k]).astype(np.int32)))
                size += w[a:b].nbytes + 12 * len(s)
                if size >= SLICE:
                    yield record(out, FOUND)
                    out, size = [], 0
        if out:
            yield record(out, FOUND)
        row += batch.num_rows


def passages_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(passage, row, doc_id, text_hash, start, words, seeds, places): the passages of all documents, whose rows are numbered."""
    facts = items.agg(F.min("need").alias("low"), F.max("width").alias("width"), F.max("by_word").alias("by_word")).first()
    held = docs.sparkSession.sparkContext.broadcast((seed_table(items)[1], bool(facts.by_word), int(facts.low or 1), int(facts.width or 1)))  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, by_word, low, width = held.value
        return passages_in(batches, TaskContext.get().partitionId() << 40, unpacked(table), by_word, low, width)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "passage long, row long, doc_id long, text_hash long, start long, words binary, seeds array<long>, places array<int>")


def rare_seeds(items: DataFrame, passages: DataFrame) -> DataFrame:
    """(seed, item, times, joined): the seeds by which an item is joined, and how many of its places each stands for."""
    seeds = items.select("item", "need", F.size("seeds").alias("p"), F.explode("seeds").alias("seed"))
    df = passages.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("df"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy("df", "seed"))  # an item's places; seeds without passages can't hit
    joined = F.least(F.col("need"), F.lit(JOINED))
    ranked = seeds.join(df, "seed", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumns({"nth": nth, "joined": joined})
    chosen = ranked.where((F.col("nth") <= F.col("p") - F.col("need") + F.col("joined")) & (F.col("df") > 0))
    return chosen.groupBy("seed", "item").agg(F.count(F.lit(1)).alias("times"), F.first("joined").alias("joined"))


def scores_in(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a passage and an item that score ``least`` of an exact copy, in batches of SCORED."""
    known: dict = {}
    for batch in slices(batches):
        out = []
        plain = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text_hash", "start", "words", "item", "item_id", "item_words", "need", "matches", "width"))
        for row, doc_id, text_hash, start, words, n, item_id, item_words, need, matches, width, seeds, places in zip(*plain, *(lists(batch.column(c)) for c in ("seeds", "places"))):
            if n not in known:
                if len(known) >= ITEMS:
                    known.clear()
                item = np.frombuffer(item_words, np.uint64)
                known[n] = item, *counted(seeds_of(item, kept(len(item), least)[0]).view(np.int64)), *counted(item)
            item, own, times, own_words, words_times = known[n]
            w, best = np.frombuffer(words, np.uint64), (0.0, 0, 0)
            for a, b in regions(places - np.int64(start), seeds, own, times, need, width):
                a = max(a, 0)
                if words_times[np.unique(places_in(own_words, w[a:b])[1])].sum() < matches:
                    continue
                points, x, y = align(w[a:b], item)
                if points > best[0]:
                    best = (points, start + a + x, start + a + y)
            if best[0] >= least * MATCH * len(item):
                out.append((row, doc_id, text_hash, n, item_id, best[0] / (MATCH * len(item)), best[1], best[2]))
        if out:
            yield record(out, SCORED)


def scored(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, first_word, last_word) per row of ``docs`` and item of which it has a copy."""
    items = materialise(items_of(benchmark, least))
    passages = materialise(passages_of(docs, items))
    rare = materialise(rare_seeds(items, passages))
    hits = attach(passages.select("passage", F.explode(F.array_distinct("seeds")).alias("seed")), rare, "seed", bound=IDS)
    pairs = hits.groupBy("passage", "item").agg(F.sum("times").alias("times"), F.first("joined").alias("joined")).where("times >= joined")
    pairs = materialise(pairs.select("passage", "item"))
    least_of = items.select("item", "item_id", F.col("words").alias("item_words"), "need", "matches", "width")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words")).alias("bytes")).first()
    found = attach(passages, pairs, "passage", bound=IDS).join(F.broadcast(least_of) if size.n <= IDS and (size.bytes or 0) <= BYTES else least_of, "item")
    rows = found.select("row", "doc_id", "text_hash", "start", "words", "seeds", "places", "item", "item_id", "item_words", "need", "matches", "width")
    rows = rows.mapInArrow(lambda batches: scores_in(batches, least), "row long, doc_id long, text_hash long, item long, item_id long, similarity double, first_word long, last_word long")
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("before"), "last_word", "doc_id", "text_hash", "item_id")).alias("b")
    out = rows.groupBy("row", "item").agg(best).select("b.doc_id", "b.text_hash", "b.item_id", "b.similarity", (-F.col("b.before")).alias("first_word"), "b.last_word")
    out = materialise(out)
    release(items, passages, rare, pairs)
    return out


def copies(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word): documents with a copy of a benchmark item, exact or edited.

    similarity is the alignment score over that of an exact copy; of equal ones in a text the first counts. Words are runs
    of letters and digits in lower case, of whole texts. Null and empty texts and items have no copies; a null id stays
    null; repeated rows give repeated results; either table may be empty. doc_id and item_id are longs, or cast to them;
    other columns are not read. The result is that of aligning every item with every document: only passages without the
    seeds or words which every alignment of that score must keep (see ``kept``) are left out.
    """
    return scored(docs, benchmark, least).drop("text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose text holds a copy of an item; all columns stay as they are, whatever their names.

    Null and empty texts stay, rows with a null doc_id are treated as others; either table may be empty. Repeated rows fare
    alike; a score of just ``least`` goes. Whole texts are read, in passages, so one of any length costs what its words do.
    """
    out_id, out_hash = (unused(c, docs.columns) for c in ("out_id", "out_hash"))
    named = materialise(scored(docs, benchmark, least).select(F.col("doc_id").alias(out_id), F.col("text_hash").alias(out_hash)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(out_id)) & (F.xxhash64("text") == F.col(out_hash))
    return attach(docs, named, same, "left_anti", IDS)
