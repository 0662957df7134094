"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import materialise, release
from rastertime.llm.text import held_out, labelled_sample

SIZES = (6, 7, 8)
BUCKETS = 1 << 22
#: Labelled rows that the fit sees at most (lowest key hashes first).
FIT_ROWS = 4000


def hashes(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of the whole text, an array for each n; in lower case, white space as one blank."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(b), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(max(SIZES), len(b))):
            h = h[: len(b) - i] * np.uint64(0x100000001B3) + b[i:]
            if i + 1 in SIZES:
                yield (((h ^ (h >> np.uint64(29)) ^ np.uint64(i + 1)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(42)).astype(np.int32)


def ngrams(text: str) -> np.ndarray:
    """Sorted distinct buckets."""
    seen = list(hashes(text))
    return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int32)


@dataclass
class NBLinear:
    weights: np.ndarray  # of a bucket that is present: coefficient times log-count ratio
    bias: float

    def score(self, text: str) -> float:
        found = [h[self.weights[h] != 0] for h in hashes(text)]  # only these few need sorting
        z = self.bias + (float(self.weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_ratios(found: DataFrame, smoothing: float = 1.0, least: int = 3, certain: float = 3.0) -> DataFrame:
    """(bucket, ratio): log-count ratios of the buckets in rows (label, f) of features, those that get a weight.

    A bucket needs ``least`` rows and a ratio at least ``certain`` of its standard errors away from 0. Tasks count in
    fixed arrays, Spark adds up.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]
        for pdf in batches:
            for label, f in zip(pdf["label"], pdf["f"]):
                by[label][np.frombuffer(f, np.int32)] += 1
        ids = np.flatnonzero(by[0] + by[1])
        for i in range(0, len(ids), 200_000):
            k = ids[i : i + 200_000]
            yield pd.DataFrame({"bucket": k.astype(np.int32), "n0": by[0][k].astype(np.int64), "n1": by[1][k].astype(np.int64)})

    rows = {r.label: r.n for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = found.select("label", "f").coalesce(8).mapInPandas(count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p, q = F.col("n1") + F.lit(smoothing), F.col("n0") + F.lit(smoothing)
    ratio = F.log(p / F.lit(smoothing * 2 + rows.get(1, 0))) - F.log(q / F.lit(smoothing * 2 + rows.get(0, 0)))
    counted = counted.where(F.col("n0") + F.col("n1") >= least).select("bucket", ratio.alias("ratio"), F.sqrt(1 / p + 1 / q).alias("error"))
    return counted.where(F.abs("ratio") >= F.col("error") * certain).select("bucket", "ratio")


def fit(features: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float = 0.005, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-penalised logistic regression on presence times ``ratio``.

    ``features`` are numbers of places in ``ratio``, ``penalty`` is per row. With one class alone, or no rows, all
    weights are 0 and the bias is the smoothed share of label 1. Entries are taken in slices, which keeps memory small.
    """
    n, ones, k = len(labels), int(labels.sum()), len(ratio)
    w, b = np.zeros(k), float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if ones == 0 or ones == n or not k:
        return w, b
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features])
    cols = np.concatenate(features).astype(np.int32, copy=False)
    slices = [slice(i, i + 500_000) for i in range(0, len(cols), 500_000)]
    g2, gb2 = np.zeros(k), 0.0
    for _ in range(rounds):  # full-batch AdaGrad
        v = ratio * w
        z = b + sum(np.bincount(rows[s], weights=v[cols[s]], minlength=n) for s in slices)
        d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        g = ratio * sum(np.bincount(cols[s], weights=d[rows[s]], minlength=k) for s in slices) + penalty * n * w
        gb = float(d.sum())
        g2 += g * g
        gb2 += gb * gb
        w -= 0.05 * g / np.sqrt(g2 + 1e-9)
        b -= 0.05 * gb / np.sqrt(gb2 + 1e-9)
    return w * ratio, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> NBLinear:
    """Fits on at most ``rows`` labelled documents (doc_id, text) outside the held-out fold.

    Null texts count as empty ones, null ids and labels other than 0 and 1 are left out, and so is a document with labels
    that disagree; repeated rows count each. Without rows, or with one label alone, scores are the label's smoothed share.
    Other columns are not read. Tasks write down hashed features, not texts. Spark counts documents by bucket and label; only those buckets that get
    a weight, and the rows' numbers among them, come to the driver.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "f": [ngrams(t if isinstance(t, str) else "").tobytes() for t in pdf["text"]]})

    found = materialise(labelled_sample(docs, labels, label, rows).mapInPandas(features, "doc_id long, label int, f binary"))
    chosen = log_ratios(found).toArrow().sort_by("bucket")
    ids, ratio = chosen["bucket"].to_numpy(), chosen["ratio"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(ids)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        for pdf in batches:
            yield pdf.assign(f=[np.flatnonzero(np.isin(known, np.frombuffer(f, np.int32), assume_unique=True)).astype(np.int32).tobytes() for f in pdf["f"]])

    got = found.mapInPandas(places, found.schema).toArrow()
    release(found)
    kept = [(i, y, np.frombuffer(f, np.int32)) for i, y, f in zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), got["f"].to_pylist())]
    kept.sort(key=lambda x: (x[0], x[1], x[2].tobytes()))
    w, bias = fit([f for _, _, f in kept], np.array([y for _, y, _ in kept], float), ratio)
    weights = np.zeros(BUCKETS, np.float32)
    weights[ids] = w
    return NBLinear(weights, bias)


def score(docs: DataFrame, model: NBLinear, cut: float = 0.3, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= ``cut``) to every row; a null text scores as an empty one.

    Repeated rows score alike; an empty table stays empty; input columns of those two names are replaced.
    """
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)  # 16 MB, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            s = np.array([m.score(t if isinstance(t, str) else "") for t in pdf[text]], float)
            yield pdf.assign(score=s, predicted=(s >= cut).astype(np.int32))

    return docs.mapInPandas(run, docs.selectExpr("*", "0D AS score", "0 AS predicted").schema)


def keep_below(docs: DataFrame, model: NBLinear, cut: float = 0.3, text: str = "text") -> DataFrame:
    """The rows that score below ``cut``, with all columns as they are, whatever their names.

    Null and empty texts score as a blank; a score of ``cut`` goes; repeated rows fare alike; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t or "") < cut for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["NBLinear", "fit", "held_out", "keep_below", "log_ratios", "ngrams", "score", "train"]
