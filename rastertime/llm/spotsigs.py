"""SpotSigs fingerprints (Theobald, Siddharth and Paepcke, 2008): chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastertime.llm.base import materialise, ordering_key, ranges
from rastertime.llm.components import components
from rastertime.llm.minhash_join import block_edges

#: Common words of English, French, German and Spanish that anchor a chain.
ANCHORS = frozenset(
    """a an and are as at be been but by can do for from had has have he her his if in into is it its no not of on one or
    our out she so than that the their them then there these they this to up was we were what when which who will with
    would you your
    au aux avec ce ces cette dans de des du elle elles en est et être il ils je la le les leur lui mais ne nous on ont ou
    où par pas plus pour qu que qui sa se ses son sont sous sur un une vous
    aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer eines er es für
    hat haben ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor
    war wenn wie wir wird zu zum zur
    al como con cuando de del desde donde el ella ellos en entre era es esta este esto fue ha han hasta la las le lo los
    más me mi muy no nos o os otra otro para pero por porque que quien se sin sobre son su sus también todo un una y ya yo""".split()
)
#: Content words in a chain.
CHAIN = 3
_LETTERS = re.compile(r"[^\W\d_]+")


def spots(text: str) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's chains.

    Where no anchor has a full chain (tables, lists of names), every word is an anchor. A text too short for that is one
    signature as a whole, so equal texts agree and others do not.
    """
    words = _LETTERS.findall(text.lower())
    content = [w for w in words if w not in ANCHORS]
    found, at = set(), 0
    last = len(content) - CHAIN
    for w in words:
        if w not in ANCHORS:
            at += 1
        elif at <= last:
            found.add(xxhash.xxh32_intdigest(" ".join((w, *content[at : at + CHAIN]))))
    if not found:
        found.update(xxhash.xxh32_intdigest(" ".join(words[i : i + CHAIN + 1])) for i in range(len(words) - CHAIN))
    if not found:
        found.add(xxhash.xxh32_intdigest("\0" + " ".join(words) if words else "\1" + text))
    return np.array(sorted(found), np.uint32)


def shown(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds fingerprint, the chain hashes in hex, to every row; a column of that name is replaced, all others stay.

    Null texts count as empty ones; equal texts, repeated rows too, have equal fingerprints; an empty table stays empty;
    memory is in proportion to the longest text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(fingerprint=[shown(spots(t if isinstance(t, str) else "")) for t in pdf[text]])

    docs = docs.drop("fingerprint")
    return docs.mapInPandas(run, docs.selectExpr("*", "'' AS fingerprint").schema)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of texts whose fingerprints reach ``percent`` hundredths of likeness.

    Equal fingerprints are one class. Classes are partitioned by set length, in steps by which a pair can at most
    differ, and posted under the rarest of their chains in their own partition and the next; lists meet in bounded
    blocks that prune by length and confirm on whole sets. Null ids have no group; null texts are empty ones, which are
    linked with one another; repeated rows get equal results; a tie in likeness with ``percent`` is a link. Empty tables
    stay empty; other columns, whatever their names, are not read; memory is in proportion to the longest text.
    """
    per_doc = materialise(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fingerprint", F.md5("fingerprint").alias("class")))
    reps = materialise(per_doc.where("doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("id"), F.first("fingerprint").alias("fingerprint")))
    n = F.expr("length(fingerprint) div 8")
    posts = reps.select("id", n.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("fingerprint"), (i * 8 + 1).cast("int"), F.lit(8)))).alias("_", "chain"))
    df = posts.groupBy("chain").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("id").orderBy("df", "chain")
    posts = posts.join(df, "chain").withColumn("nth", F.row_number().over(rarest))
    posts = posts.where((F.col("nth") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1) & (F.col("df") > 1))
    length = F.floor(F.log(F.col("size").cast("double")) / F.lit(-float(np.log(percent / 100)))).cast("int")
    posts = posts.select("id", "size", F.explode(F.array(length, length + 1)).alias("length"), "chain")
    posts = materialise(posts.select("id", "size", F.xxhash64("length", "chain").alias("list")))
    lists = posts.join(posts.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "list")
    sets = reps.select("id", F.unhex("fingerprint").alias("s"))
    groups = components(block_edges(lists.withColumn("component", F.col("id")), sets, percent, ">u4"))
    of = reps.join(groups, "id", "left").select("class", F.coalesce("component", "id").alias("component_id"))
    return per_doc.join(of, "class", "left").select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Deals rows out by ranges of ``key`` and puts the first row of the following range at the end of each.

    Columns: pid, extra (1 for the borrowed row), key, text; sorted in each partition. A null key comes first, ties are
    ordered by a hash of the text. Only the range bounds, one per partition, pass through the driver.
    """
    docs = docs.select(ordering_key(key).alias("key"), F.col(key).cast("long").alias(key), text)
    ids = docs.select("key")
    pid, count = ranges(ids, "key")
    first = ids.groupBy(pid.alias("pid")).agg(F.min("key").alias("key"))
    after = Window.orderBy("pid")  # a row per range
    lent = first.select("pid", F.coalesce(F.lead("key").over(after), F.min("key").over(Window.partitionBy())).alias("lent"))
    lent = materialise(lent.groupBy("lent").agg(F.collect_list("pid").alias("to")))
    rows = docs.withColumn("pid", pid).join(F.broadcast(lent), F.col("key") == F.col("lent"), "left")
    own = F.array(F.struct(F.col("pid").cast("int").alias("pid"), F.lit(0).alias("extra")))
    borrowed = F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda p: F.struct(p.cast("int").alias("pid"), F.lit(1).alias("extra")))
    rows = rows.select("key", key, text, F.explode(F.concat(own, borrowed)).alias("at")).select("at.pid", "at.extra", "key", key, text)
    return rows.repartitionById(count, F.col("pid")).sortWithinPartitions("pid", "extra", "key", F.xxhash64(text))


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter gives way to the next document's beginning.

    A row for each row of ``docs``, in the order of ``key`` (a long, or cast to one): a null key comes first, rows with one
    key are ordered by a hash of the text, and after the last comes the first. Null texts are empty ones; a single row is
    its own next; an empty table stays empty. Other columns are not read. Memory is in proportion to the longest text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before, until the row after it comes

        def row(one, following):
            doc_id, t, mine = one
            _, after, theirs = following
            k = len(t) // 4
            edited = t[: len(t) - k] + after[:k]
            new = spots(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, len(t), digest, shown(mine), shown(new), likeness(mine, new), likeness(mine, theirs)

        for pdf in batches:
            out = []
            for extra, doc_id, t in zip(pdf["extra"], pdf[key], pdf[text]):
                if extra and held is None:
                    continue
                t = t if isinstance(t, str) else ""
                now = (None if pd.isna(doc_id) else int(doc_id), t, spots(t))
                if held is not None:
                    out.append(row(held, now))
                held = None if extra else now
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64", "n_chars": "int64"})

    return with_next(docs, key, text).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
