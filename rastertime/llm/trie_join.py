"""Spelling variants: a self-join of a vocabulary trie by active-node sets (Wang, Feng and Li, 2010) at distance one.

Two words at distance one agree up to their first difference and, but for one character, after it. A partition of the trie holds
the words that share their first ``head`` and last ``tail`` characters, met as ``m`` (the length of the shorter word of a
pair; the other has m or m + 1), with the first difference in the middle between. Each word starts in two partitions for
each m: by the first half of m, and by the rest of m from the end, for differences in the second and in the first half.
So every pair is in just one. A partition beyond WORDS or CHARS is split again in the middle's halves, until it is small
or its middle is one character; then it holds no more words than the alphabet and its square.

In a task a partition's middles form a trie. Each node gets its set of active nodes, those at distance one, from its
parent's: what the parent's active nodes reach by the same character, the parent (a deletion), the node's siblings (a
replacement) and its children (an insertion). Words in the set of a word's node are near it. A partition puts out a row
for each word, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import materialise, release

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of fewer code points, or with fewer occurrences, don't count. One run in TYPO loses a character.
LENGTH, OCCURRENCES, TYPO = 5, 3, 97
#: Words and characters up to which a partition is joined in one task.
WORDS, CHARS = 2_000, 200_000
KEY = ["m", "a", "b", "head", "tail"]


def runs(docs: DataFrame) -> DataFrame:
    """(id, run): the maximal runs of letters of every text with A-Z in lower case; a null id counts as an empty text."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    return found.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("run"))


def with_typos(rows: DataFrame, every: int = TYPO) -> DataFrame:
    """(word): the run, or without one of its characters where ``every`` divides the crc32 of id:run."""
    h, n = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (F.col("h") % n).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, n))
    return rows.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the vocabulary; counts sum before the shuffle."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("word", "n", "m", "a", "b", F.substring(F.col("word"), F.lit(1), F.col("a")).alias("head"), F.right("word", F.col("b")).alias("tail"))


def first_partitions(vocabulary: DataFrame) -> DataFrame:
    """Each word as the shorter and as the longer one of a pair, under half of m from the front and the rest from the end."""
    size = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")
    half = F.expr("m div 2").cast("int")
    ends = F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (F.col("m") - half).alias("b")))
    return _placed(rows.select("word", "n", "m", F.explode(ends).alias("at")).select("word", "n", "m", "at.a", "at.b"))


def split(rows: DataFrame) -> DataFrame:
    """Partitions split in the halves of their middles."""
    cut = F.col("a") + F.expr("(m - a - b) div 2").cast("int")
    ends = F.array(F.struct(cut.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("m") - cut).alias("b")))
    return _placed(rows.select("word", "n", "m", F.explode(ends).alias("at")).select("word", "n", "m", "at.a", "at.b"))


def partitioned(vocabulary: DataFrame) -> list[DataFrame]:
    """Tables of (word, n, *KEY) whose partitions fit a task; those that hold no pair are left out."""
    ready, todo = [], first_partitions(vocabulary)
    while True:
        size = F.length("word")
        facts = todo.groupBy(*KEY).agg(F.count(F.lit(1)).alias("words"), F.sum((size == F.col("m")).cast("int")).alias("short"), F.sum(size).alias("chars"))
        facts = facts.where("words > 1 AND short > 0").select(*KEY, ((F.col("words") > WORDS) | (F.col("chars") > CHARS)).alias("large"))
        sized = materialise(todo.join(facts, KEY).select("word", "n", *KEY, (F.col("large") & (F.col("m") - F.col("a") - F.col("b") > 1)).alias("over")))
        ready.append(sized)
        over = sized.where("over")
        if over.isEmpty():
            return ready
        todo = split(over)


def near_nodes(middles: list[str]) -> list[list[int]]:
    """For each of distinct strings the places of those at distance one, by active-node sets in their trie."""
    kids, end = [{}], [-1]
    for i, w in enumerate(middles):
        at = 0
        for ch in w:
            to = kids[at].get(ch)
            if to is None:
                to = kids[at][ch] = len(kids)
                kids.append({})
                end.append(-1)
            at = to
        end[at] = i
    out: list[list[int]] = [[] for _ in middles]
    todo = [(0, set(kids[0].values()))]
    while todo:
        node, active = todo.pop()
        if end[node] >= 0:
            out[end[node]] = [end[v] for v in active if end[v] >= 0]
        for ch, child in kids[node].items():
            reached = {kids[v][ch] for v in active if ch in kids[v]}
            reached.add(node)
            reached.update(kids[node].values())
            reached.update(kids[child].values())
            reached.discard(child)
            todo.append((child, reached))
    return out


def near(rows: DataFrame) -> DataFrame:
    """(word, near, best_n, best): per partition and word with near ones, how many, and the commonest, ties by code points."""

    def partition(words: list[str], counts: list[int], m: int, a: int, b: int) -> list[tuple]:
        mid, out = m - a - b, []
        middles = [w[a : len(w) - b] for w in words]
        for i, found in enumerate(near_nodes(middles)):
            own = middles[i]
            if len(own) > mid:
                found = [j for j in found if len(middles[j]) == mid]
            if b:  # a difference at the end of the middle belongs to a partition with a longer head
                found = [j for j in found if len(middles[j]) == len(own) or not (own.startswith(middles[j]) or middles[j].startswith(own))]
            if found:
                least = min((-counts[j], words[j]) for j in found)
                out.append((words[i], len(found), -least[0], least[1]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, words, counts = None, [], []
        for pdf in batches:
            out = []
            for word, n, *at in zip(*(pdf[c].tolist() for c in ("word", "n", *KEY))):
                if at != key:
                    if words:
                        out += partition(words, counts, *key[:3])
                    key, words, counts = at, [], []
                words.append(word)
                counts.append(n)
            yield table(out)
        if words:
            yield table(partition(words, counts, *key[:3]))

    def table(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["word", "near", "best_n", "best"]).astype({"near": "int64", "best_n": "int64"})

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(run, "word string, near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): what each word of (word, form) reaches by following forms to the last, by doubling, as a table to release."""
    to = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        far = to.select(F.col("word").alias("root"), F.col("root").alias("far"))
        more = materialise(to.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        release(to)
        to = more
        if to.where("moved").isEmpty():
            return to


def variants(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of ``vocabulary`` (word, n; each word once, none null).

    near words are at distance one: a character inserted, deleted or replaced. form is the near word of the largest n,
    the smallest in code-point order among equals, if that n is at least ``times`` the word's (2 or more, so forms never go in circles), else
    null, as for words without near ones; form_n is its n. root follows forms to the last. A word of any length may come; an empty
    table stays empty; other columns, whatever their names, are not read.
    """
    vocabulary = vocabulary.select("word", "n")
    ready = partitioned(vocabulary)
    parts = reduce(DataFrame.unionByName, [r.where("NOT over").drop("over") for r in ready])
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best"))).alias("best")
    found = materialise(near(parts).groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "best.best", (-F.col("best.minus")).alias("best_n")))
    named = vocabulary.join(found, "word", "left").withColumn("kept", F.col("best_n") >= times * F.col("n"))
    named = materialise(named.select("word", F.when(F.col("kept"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("kept"), F.col("best_n")).alias("form_n")))
    last = roots(named.where("form IS NOT NULL"))
    out = materialise(named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    release(*ready, found, named, last)
    return out


def spelling_groups(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text), after the typos of ``with_typos``.

    Whole texts are read; null and empty ones have no words, repeated rows count each time, a null doc_id counts as an empty
    text. An empty table gives no word; other columns, whatever their names, are not read.
    """
    vocabulary = materialise(counted(with_typos(runs(docs.select("doc_id", "text")))))
    out = variants(vocabulary)
    release(vocabulary)
    return out
