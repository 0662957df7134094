"""Near-duplicate groups by a signature-coordinate inverted join over MinHash signatures, confirmed on full shingle sets.

1. Each text gets the key of its word sequence, its number of shingles and a signature of K minima. Texts with one word
   sequence are one class, of which one row goes on.
2. Classes are posted under each coordinate's value (the coordinates hash differently, so a value names its coordinate).
   Values that one class alone has cannot collide, and are dropped after a count that sums before the shuffle. A class
   with fewer than M shared values cannot reach M collisions.
3. Prefix: of its c shared values a class keeps the c - M + 1 that fewest classes share; two classes with M collisions
   meet in at least one of them. The longer lists are skipped, never merged. Lists with the same members are one.
4. Stars: each list's members meet its smallest id alone, which is linear in the postings. Pairs with M collisions of
   their signatures whose sketches (a minimum in each of BINS bins) don't rule the link out are confirmed on full sets;
   the links found join components.
5. Rest: lists whose members are still in several components meet in blocks of sketches, which give the members that may
   be linked to another component. Only these meet again in blocks bounded by members and by shingles, where full sets
   are compared as matrices inside the task. A block returns edges between components, fewer than it has members, so a
   large group never puts out its pairs. A pair within a component needs no test.
6. Components of all confirmed links are the groups.

Joins on a list deal its rows by (list, part), so that a list with very many members spreads over tasks. A pair at 0.85
collides in fewer than M = 13 of K = 32 coordinates with a chance under 1e-8 (3e-7 at 0.80), and its sketches rule it out
with a chance under 1e-8; a link between two classes is lost only if no other path joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import attach, materialise, release, unused
from rastertime.llm.components import components
from rastertime.llm.text import WordHashes, mixed, shingle_set, words

K, M = 32, 13
#: Bins of a sketch, and by how many deviations an estimate may fall short of a link.
BINS, SHORT = 256, 6.5
#: Members of a list on each side of a block of full sets and of a block of sketches, and shingles on each side of the former.
BLOCK, SKETCHES, SHINGLES = 512, 2048, 1_000_000
#: Rows of a list that one part of it holds, parts of a hub's pairs, ids that are broadcast at most.
SPREAD, PARTS, IDS = 512, 64, 1_000_000
_MULTIPLY = mixed(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mixed(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signature(shingles: np.ndarray) -> np.ndarray:
    """K minima of the shingle hashes under K multiply-add orders, in slices that keep memory small."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            low = np.minimum(low, mixed(shingles[i : i + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return low.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of BINS bins of hashed shingles, eight bits of the least one, 1 to 255; 0 for an empty bin."""
    h = np.sort(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    at = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[at[first]] = 1 + (h[first] % np.uint64(255)).astype(np.uint8)
    return out


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches (rows of ``a`` with rows of ``b``, or one row) leave a link possible."""
    empty = np.count_nonzero((a | b) == 0, axis=-1) if not (b.all() or a.all()) else 0
    same, n, t = np.count_nonzero(a == b, axis=-1) - empty, BINS - empty, percent / 100
    return same >= t * n - SHORT * np.sqrt(t * (1 - t) * n)


def class_of(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of words."""
    with np.errstate(over="ignore"):
        at = np.arange(1, len(hashes) + 1, dtype=np.uint64)
        hi = mixed(hashes + at * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)
        lo = mixed(hashes ^ mixed(at * np.uint64(0xD1B54A32D192ED03))).sum(dtype=np.uint64).view(np.int64)
    return int(hi), int(lo)


def signatures(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, text_hash, class_hi, class_lo, n_shingles, sig) per row; a text without words has no class and no signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for pdf in batches:
            out = []
            for doc_id, text_hash, text in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"]):
                h = seen.of(words(text if isinstance(text, str) else ""))
                if not len(h):
                    out.append((doc_id, text_hash, None, None, 0, None))
                    continue
                s = shingle_set(h, n)
                out.append((doc_id, text_hash, *class_of(h), len(s), signature(s)))
            made = pd.DataFrame(out, columns=["doc_id", "text_hash", "class_hi", "class_lo", "n_shingles", "sig"])
            yield made.astype({"doc_id": "Int64", "text_hash": "int64", "class_hi": "Int64", "class_lo": "Int64", "n_shingles": "int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(run, "doc_id long, text_hash long, class_hi long, class_lo long, n_shingles long, sig array<long>")


def shingle_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """(class_hi, class_lo, size, sketch, s) per row with words; s holds the sorted shingle hashes as bytes of 64-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                h = seen.of(words(text if isinstance(text, str) else ""))
                if len(h):
                    s = shingle_set(h, n)
                    out.append((*class_of(h), len(s), sketch(s).tobytes(), s.tobytes()))
            yield pd.DataFrame(out, columns=["class_hi", "class_lo", "size", "sketch", "s"]).astype({"class_hi": "int64", "class_lo": "int64", "size": "int64"})

    return docs.select("text").mapInPandas(run, "class_hi long, class_lo long, size long, sketch binary, s binary")


def posting_lists(classes: DataFrame) -> DataFrame:
    """(list, n, id): deduplicated prefix lists of classes (id, sig) that may collide M times."""
    posts = classes.select("id", F.explode("sig").alias("value"))
    shared = posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = posts.join(shared, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))  # K at most
    mine = mine.where(F.size("v") >= M)
    kept = materialise(mine.select("id", F.explode(F.slice(F.col("v"), 1, F.size("v") - (M - 1))).alias("v")).select("id", "v.df", "v.value"))
    same = kept.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.first("df").alias("df"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"))
    one = same.where("n > 1").groupBy("n", "h1", "h2").agg(F.min(F.struct("value", "df")).alias("p")).select("p.value", "p.df", "n")
    one = one.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("df") - 1) / SPREAD).cast("int"))))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), ((F.col("df") - 1) / SPREAD).cast("int") + 1).cast("int"))
    lists = materialise(dealt.join(one.drop("df"), ["value", "part"]).select(F.col("value").alias("list"), "n", "id"))
    release(kept)
    return lists


def with_list(rows: DataFrame, facts: DataFrame, n: str = "n") -> DataFrame:
    """Joins a row of facts per list (list, n, ...) to the rows of the lists (list, n, id, ...), a long list in parts."""
    last = ((F.col(n) - 1) / SPREAD).cast("int")
    facts = facts.withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop(n)
    return rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), last + 1).cast("int")).join(facts, ["list", "part"]).drop("part")


def collisions(a: Column, b: Column) -> Column:
    """In how many coordinates two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def with_both(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of either id, {column}_a and {column}_b; an id in very many pairs comes in parts."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b", F.lit(3)), F.lit(PARTS)).cast("int"))
    of = lambda side: facts.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    hubs = pairs.select("a", "part").distinct().join(of("a"), "a")
    return pairs.join(hubs, ["a", "part"]).drop("part").join(of("b"), "b")


def star_pairs(lists: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b): each list's smallest id with every other member of the list that it collides with M times."""
    hub = lists.groupBy("list", "n").agg(F.min("id").alias("a"))
    pairs = with_list(lists, hub).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    return with_both(pairs, signed, ["sig"]).where(collisions(F.col("sig_a"), F.col("sig_b")) >= M).select("a", "b")


def unsettled(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists whose members are in more than one component, with the component of each member."""
    rows = lists.join(groups, "id", "left").select("list", "n", "id", F.coalesce("component", "id").alias("component"))
    open_ = rows.groupBy("list", "n").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return with_list(rows, open_.select("list", "n"))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            yield pdf.loc[may_link(a, b, percent), ["a", "b"]]

    return with_both(pairs, sets, ["sketch"]).select("a", "b", "sketch_a", "sketch_b").mapInPandas(test, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, kind: str = "<u8") -> DataFrame:
    """The pairs (a, b) with |A and B| * 100 >= percent * |A or B|; ``kind`` is how a set's bytes are read."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = []
            for x, y in zip(pdf["s_a"], pdf["s_b"]):
                small, large = sorted((np.frombuffer(x, kind), np.frombuffer(y, kind)), key=len)
                if len(small) * 100 < percent * len(large):
                    hit.append(False)
                    continue
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                hit.append(both * 100 >= percent * (len(small) + len(large) - both))
            yield pdf.loc[np.array(hit, bool), ["a", "b"]]

    return with_both(pairs, sets, ["s"]).select("a", "b", "s_a", "s_b").mapInPandas(test, "a long, b long")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The matrix of links |A and B| * 100 >= percent * |A or B| among full sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    links = np.zeros((len(sets), len(sets)), bool)
    tokens, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(row[df[at] > 1], minlength=len(sets))
    may = np.flatnonzero(shared * 100 >= percent * sizes)  # the others have too much that no set here shares
    if len(may) < 2:
        return links
    place = np.full(len(sets), -1)
    place[may] = np.arange(len(may))
    keep = (place[row] >= 0) & (df[at] > 1)
    row, (used, col) = place[row[keep]], np.unique(at[keep], return_inverse=True)
    both = np.zeros((len(may), len(may)), np.float32)
    width = max(1, 4_000_000 // len(may))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, len(used), width):
        a, b = np.searchsorted(col, [start, start + width])
        m = np.zeros((len(may), min(width, len(used) - start)), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        both += m @ m.T
    both, own = both.astype(np.int64), sizes[may]
    links[np.ix_(may, may)] = both * 100 >= percent * (own[:, None] + own[None, :] - both)
    return links


def spanning(links: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """Edges (a, b) between components ``of`` the members that join whatever the links join, fewer than there are members."""
    names, at = np.unique(of, return_inverse=True)
    low = np.arange(len(names))
    i, j = np.nonzero(links & (at[:, None] != at[None, :]))
    while True:
        new = low.copy()
        np.minimum.at(new, at[i], low[at[j]])
        new = new[new]
        if (new == low).all():
            return [(int(names[a]), int(names[b])) for a, b in enumerate(low) if a != b]
        low = new


def in_blocks(lists: DataFrame, side: Column) -> DataFrame:
    """Rows of lists (list, id, component, ...) once per block, a pair of parts of a list; ``side`` is how many parts it has."""
    met = lists.withColumn("parts", side.cast("int")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("block", F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))).drop("parts", "own", "other")


def boundary(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(list, n, id, component, size): members that sketches allow a link with a member of another component in their list."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ignore_index=True)
        of, size = pdf["component"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        found = np.zeros(len(pdf), bool)
        if (of != of[0]).any():
            x = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, BINS)
            up_to = np.searchsorted(size, size * 100 // percent, side="right")  # larger sets have too little in common
            for i, end in enumerate(up_to.tolist()):
                j = np.flatnonzero(of[i + 1 : end] != of[i]) + i + 1
                if found[i]:
                    j = j[~found[j]]
                if len(j):
                    hit = j[may_link(x[j], x[i], percent)]
                    found[hit] = True
                    found[i] |= len(hit) > 0
        return pdf.loc[found, ["list", "n", "id", "component", "size"]]

    met = in_blocks(lists, F.ceil(F.col("n") / SKETCHES)).join(sets.select("id", "size", "sketch"), "id")
    return met.groupBy("block").applyInPandas(meet, "list long, n long, id long, component long, size long").distinct()


def block_edges(lists: DataFrame, sets: DataFrame, percent: int, kind: str = "<u8") -> DataFrame:
    """(a, b): edges between components that span every link of every list, from blocks bounded by members and elements.

    ``lists``: list, n (its members, or more), id, component, size (of the set). ``kind`` is how a set's bytes are read.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        of = pdf["component"].to_numpy(np.int64)
        got = spanning(linked([np.frombuffer(s, kind) for s in pdf["s"]], percent), of) if (of != of[0]).any() else []
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    known = lists.groupBy("list", "n").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("elements"), F.min("component").alias("low"), F.max("component").alias("high"))
    known = known.where("low < high").select("list", "n", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("elements") / SHINGLES)).alias("side"))
    met = in_blocks(with_list(lists, known), F.col("side")).select("block", "id", "component")
    return met.join(sets.select("id", "s"), "id").groupBy("block").applyInPandas(meet, "a long, b long")


def linked_components(lists: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes that any link joins to another, as a table that the caller releases."""
    pairs = materialise(possible(star_pairs(lists, signed), sets, percent))
    links = materialise(confirmed(pairs, sets, percent))
    first = components(links)
    rest = materialise(unsettled(lists, first))
    edge = materialise(boundary(rest, sets, percent))
    more = materialise(block_edges(edge, sets, percent))
    out = components(links.unionByName(more))
    release(pairs, links, first, rest, edge, more)
    return out


def grouped(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, doc) per row; doc is the smallest doc_id of its group, component names
    the group where there are other rows in it, and is null where there are none."""
    per_doc = materialise(signatures(docs, n))
    has = per_doc.where("class_hi IS NOT NULL")
    reps = has.groupBy("class_hi", "class_lo").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig"))
    reps = materialise(reps.withColumn("id", F.monotonically_increasing_id()))
    lists = posting_lists(reps)
    members = materialise(lists.select("id").distinct().join(reps.select("id", "class_hi", "class_lo", "doc"), "id"))
    named = members.select(F.col("doc").alias("member")).distinct()
    texts = attach(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), named, F.col("doc_id").eqNullSafe(F.col("member")), "left_semi", IDS)
    sets = materialise(attach(shingle_sets(texts, n), members.drop("doc"), ["class_hi", "class_lo"], bound=IDS).drop("class_hi", "class_lo"))
    if sets.count() > members.count():  # repeated rows
        once = materialise(sets.groupBy("id").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "s")]))
        release(sets)
        sets = once
    groups = linked_components(lists, reps, sets, percent)
    release(lists, members, sets)
    several = reps.join(groups, "id", "left").where("component IS NOT NULL OR rows > 1").select("class_hi", "class_lo", F.coalesce("component", "id").alias("component"), "doc")
    least = several.groupBy("component").agg(F.min("doc").alias("doc"))
    several = materialise(several.drop("doc").join(least, "component"))
    # where the classes are too many to broadcast, adaptive execution splits one that holds very many rows
    out = attach(per_doc.drop("sig"), several, ["class_hi", "class_lo"], "left")
    out = materialise(out.select("doc_id", "text_hash", "n_shingles", "component", F.coalesce("doc", "doc_id").alias("doc")))
    release(per_doc, reps, groups, several)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text); doc_id is a long, or casts to one.

    Links are pairs of texts whose sets of distinct ``n``-word shingles have at least ``percent`` hundredths of their
    union in common. component_id is the smallest doc_id reachable from the row's text; kept marks that document. Texts
    without words, null ones too, have no set and are alone. Rows of one doc_id with different texts are grouped each by
    its own text. A null doc_id counts as the largest: it joins a group, and has a null component where it is alone.
    Repeated rows get equal results, and groups that tie don't exist. Memory is in proportion to the longest text. Empty
    tables stay empty; other columns, whatever their names, are not read.
    """
    out = grouped(docs.select("doc_id", "text"), percent, n)
    return out.select("doc_id", "n_shingles", F.col("doc").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("doc"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """One row of ``docs`` of each group of linked texts: that with the smallest doc_id, then text hash.

    All columns stay as they are, whatever their names. Of repeated rows one stays. Texts without words are alone and
    stay. Rows of one doc_id whose texts aren't linked stay. Rows with a null doc_id can't be told apart by it, and all
    stay. An empty table stays empty. Rows that go are taken out by a join with their ids alone; only those of which one
    of several equal ones stays go through an aggregate.
    """
    found = grouped(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), percent, n)
    rows = found.where("component IS NOT NULL")
    key = F.struct("doc_id", "text_hash")
    first = materialise(rows.groupBy("component").agg(F.min(key).alias("first")))
    counted = rows.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    counted = attach(counted, first, "component").withColumn("stays", key == F.col("first"))
    out_id, out_hash, row = (unused(c, docs.columns) for c in ("out_id", "out_hash", "row"))
    named = materialise(counted.where("NOT stays OR times > 1").select(F.col("doc_id").alias(out_id), F.col("text_hash").alias(out_hash), "stays"))
    release(found, first)
    same = (F.col("doc_id").cast("long") == F.col(out_id)) & (F.xxhash64("text") == F.col(out_hash))
    kept = attach(docs, named.select(out_id, out_hash), same, "left_anti", IDS)
    again = named.where("stays")
    if again.isEmpty():
        return kept
    several = docs.join(again.select(out_id, out_hash), same)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = several.groupBy(out_id, out_hash).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(row))
    return kept.unionByName(one.select(f"{row}.*"))
