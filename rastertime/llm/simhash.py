"""SimHash fingerprints and their near-duplicates by multi-index hashing (Norouzi, Punjani and Fleet, 2012).

1. A fingerprint has a bit for each bit that more than half of a text's shingle hashes set. Equal fingerprints are one node.
2. Two segments of 32 bits: of at most DISTANCE = 3 differing bits one segment has at most one. Each node posts its two
   segment values (its own), and the values in the ball of radius 1 around each that have one bit fewer (its probes):
   of two values that differ in one bit, one has a bit fewer, so a half of the ball is enough.
3. A table is the list of nodes under one segment value. Lists without an own value, or of one node, hold no pair.
4. Stars: each node of a list meets the smallest own node there, which is linear in the postings. The links found, their
   complete distances verified, join components.
5. Rest: lists whose nodes are still in several components meet in blocks, where complete distances are compared inside
   the task. A block returns edges between components, fewer than it has nodes, so no group puts out its pairs.
6. Components of all links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import attach, materialise, release
from rastertime.llm.components import components
from rastertime.llm.minhash_join import in_blocks
from rastertime.llm.text import words

#: Differing bits up to which fingerprints are linked; two segments find all pairs up to 3.
DISTANCE = 3
SEED = 42
#: Nodes of a list on each side of a block; hashes whose bits are counted at a time.
SIDE, SLICE = 2048, 1 << 16


def fingerprint(text: str, n: int = 3) -> int:
    """The 64-bit fingerprint of a text's ``n``-word shingles, repeats included; 0 without words."""
    found = words(text)
    if not found:
        return 0
    joined, width = b" ".join(found), min(n, len(found))
    ends = list(accumulate(len(w) + 1 for w in found))
    digest, spans = xxhash.xxh64_intdigest, list(zip([0, *ends], ends[width - 1 :]))
    bits = np.zeros(64, np.int64)
    for i in range(0, len(spans), SLICE):
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in spans[i : i + SLICE]], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) per row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = np.array([fingerprint(t if isinstance(t, str) else "", n) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": made.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def postings(nodes: DataFrame) -> DataFrame:
    """(list, id, exact): every node under its two segment values and under those with one of their bits cleared."""
    low = F.lit((1 << 32) - 1)

    def ball(value: Column, table: int) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        fewer = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: value.bitwiseAND(bit(i)) != 0), lambda i: value.bitwiseXOR(bit(i)))
        return F.transform(F.concat(F.array(value), fewer), lambda v, at: F.struct((v + F.lit(table << 32)).alias("list"), (at == 0).alias("exact")))

    both = F.concat(ball(F.col("id").bitwiseAND(low), 0), ball(F.shiftrightunsigned("id", 32), 1))
    return nodes.select("id", F.explode(both).alias("at")).select("at.list", "id", "at.exact")


def tables(nodes: DataFrame) -> DataFrame:
    """(list, n, id, exact, hub): the lists that may hold a link, with their smallest own node.

    Spark sizes postings by their nodes, of which each has about 34, so the hint keeps it from broadcasting them.
    """
    posts = postings(nodes)
    facts = posts.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("exact"), F.col("id"))).alias("hub")).where("n > 1 AND hub IS NOT NULL")
    return posts.hint("merge").join(facts, "list").select("list", "n", "id", "exact", "hub")


def block_links(lists: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): edges between components that span every link of every list (list, n, id, exact, component)."""

    def meet(fp: np.ndarray, own: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
        names, at = np.unique(of, return_inverse=True)
        low, out = np.arange(len(names)), []
        if len(names) > 1:
            for i in np.flatnonzero(own):
                ends = np.unique(low[at[np.bitwise_count(fp ^ fp[i]) <= distance]])
                if len(ends) > 1:
                    out += [(int(names[ends[0]]), int(names[e])) for e in ends[1:]]
                    low[np.isin(low, ends[1:])] = ends[0]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the rows of the last block, which may go on in the next batch
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            block = pdf["block"].to_numpy()
            cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()]
            held = pdf.iloc[cut[-1] :]
            yield blocks(pdf, cut)
        if held is not None:
            yield blocks(held, [0, len(held)])

    def blocks(pdf: pd.DataFrame, cut: list[int]) -> pd.DataFrame:
        fp, own, of = pdf["id"].to_numpy(np.int64).view(np.uint64), pdf["exact"].to_numpy(bool), pdf["component"].to_numpy(np.int64)
        found = [e for a, b in zip(cut, cut[1:]) for e in meet(fp[a:b], own[a:b], of[a:b])]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    met = in_blocks(lists, F.ceil(F.col("n") / SIDE)).select("block", "id", "exact", "component")
    return met.repartition("block").sortWithinPartitions("block").mapInPandas(run, "a long, b long")


def linked(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(id, component) of the fingerprints that any link joins to another, as a table that the caller releases."""
    lists = materialise(tables(nodes))
    near = F.bit_count(F.col("id").bitwiseXOR(F.col("hub"))) <= distance
    stars = materialise(lists.where((F.col("id") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    first = components(stars)
    rows = lists.drop("hub").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = rows.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("list")
    rest = materialise(rows.join(open_, "list"))
    more = materialise(block_links(rest, distance).distinct())
    out = components(stars.unionByName(more))
    release(lists, stars, first, rest, more)
    return out


def near_duplicates(docs: DataFrame, n: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text); doc_id is a long, or casts to one.

    Links are pairs of fingerprints that differ in at most ``distance`` bits, 3 or fewer. component_id is the smallest
    doc_id that a row reaches by links, itself included. A text without words, a null one too, has fingerprint zero and
    is linked like any other; one with fewer than ``n`` words has a single shingle. A bit that exactly half of the
    shingles set is 0. A null doc_id counts as the largest, and has a null component among null ones alone. Repeated
    rows get equal results. Memory is in proportion to the longest text. Empty tables stay empty; other columns,
    whatever their names, are not read.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"two segments find pairs up to {DISTANCE} bits apart")
    per_doc = materialise(fingerprints(docs, n))
    nodes = materialise(per_doc.groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows")))
    groups = linked(nodes, distance)
    several = nodes.join(groups, "id", "left").where("component IS NOT NULL OR rows > 1").select("id", F.coalesce("component", "id").alias("component"), "doc")
    least = several.groupBy("component").agg(F.min("doc").alias("doc"))
    several = materialise(several.drop("doc").join(least, "component").select(F.col("id").alias("fp"), "doc"))
    out = attach(per_doc, several, "fp", "left")
    out = materialise(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("doc", "doc_id").alias("component_id")))
    release(per_doc, nodes, groups, several)
    return out
