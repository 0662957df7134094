"""Text primitives for the operators that run Python inside tasks: words, shingles, labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, as UTF-8; bytes.split() parts at just these six bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words of a task; forgets all when it has grown past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in items), np.uint64, len(items))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order. Shorter sequences have none."""
    if len(hashes) < n:
        return hashes[:0]
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mixed(out * MIX + hashes[i : len(hashes) - n + 1 + i])
    return out


def shingle_set(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted distinct n-word shingles; a shorter sequence is one shingle as a whole."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, min(n, len(hashes))))


def per_text(df: DataFrame, fn, schema: str, text: str = "text") -> DataFrame:
    """Maps each row by fn(row dict without the text, text or '') -> dict of the new columns, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = fn()
        for pdf in batches:
            texts = pdf[text].tolist()
            made = [step(t if isinstance(t, str) else "") for t in texts]
            rest = pdf.drop(columns=[text])
            more = pd.DataFrame(made, index=rest.index)
            yield pd.concat([rest, more], axis=1)

    return df.mapInPandas(run, schema)


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the documents labelled 0 or 1, without those whose labels disagree."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out fold, lowest key hashes first.

    Only ids and labels are sorted, by a bounded top-k; texts join the bounded list of ids.
    """
    own = agreed(labels, label).where(~held_out(F.col("doc_id")))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "text", "label")


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
