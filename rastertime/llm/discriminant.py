"""Quality by a regularised quadratic discriminant (Friedman, 1989) over transformed statistics of each whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import materialise, release
from rastertime.llm.text import agreed, held_out

#: What a text is described by, in the order of the vector.
STATISTICS = ("log_words", "log_word_bytes", "upper", "marks", "digits", "distinct_words", "top_word", "distinct_lines", "repeated_next", "log_line_words", "short_words", "long_words", "entropy", "high_bytes")
#: Labelled rows on which the log-density difference is calibrated at most (lowest key hashes first).
CALIBRATION_ROWS = 20_000


def _logit(share: float) -> float:
    return float(np.log((share + 0.005) / (1.005 - share)))


def statistics(text: str) -> list[float]:
    """Shares are taken to log odds and counts to logarithms, which brings both nearer to normal within a class."""
    raw = text.encode("utf-8", "replace")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = raw.lower().split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(h[65:91].sum() + h[97:123].sum()))
    marks = int(h[33:44].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum())
    p = h[h > 0] / n
    return [
        float(np.log1p(len(words))),
        float(np.log1p(n / k)),
        _logit(h[65:91].sum() / letters),
        _logit(marks / n),
        _logit(h[48:58].sum() / n),
        _logit(len(counts) / k),
        _logit(max(counts.values(), default=0) / k),
        _logit(len(set(lines)) / max(1, len(lines))),
        _logit(sum(a == b for a, b in zip(words, words[1:])) / k),
        float(np.log1p(k / max(1, len(lines)))),
        _logit(sum(len(w) <= 3 for w in words) / k),
        _logit(sum(len(w) >= 10 for w in words) / k),
        float(-(p * np.log(p)).sum()),
        _logit(h[128:].sum() / n),
    ]


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse lower Cholesky factors of the class covariances
    offsets: list[float]  # log prior minus half the log determinant
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 minus that of label 0, priors included, for rows of statistics."""
        z = (x - self.centre) / self.scale
        one, none = (o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means[::-1], self.factors[::-1], self.offsets[::-1]))
        return one - none

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -40, 40)))


def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooling: float = 0.2, ridge: float = 0.05) -> Discriminant:
    """From count, sum and sum of products per class. ``pooling`` shrinks a class covariance to the pooled one, ``ridge``
    that to a multiple of the identity. A class without rows takes the pooled moments, so scores stay at the prior."""
    d = len(STATISTICS)
    got = {k: moments.get(k, (0, np.zeros(d), np.zeros((d, d)))) for k in (0, 1)}
    n = max(1, sum(v[0] for v in got.values()))
    centre = sum(v[1] for v in got.values()) / n
    total = sum(v[2] for v in got.values()) / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(total), 1e-6))
    inside = np.zeros((d, d))
    means, own = [], []
    for k in (0, 1):
        m, s, ss = got[k]
        mean = s / m if m else centre
        cov = (ss / m - np.outer(mean, mean) if m else total) / np.outer(scale, scale)
        means.append((mean - centre) / scale)
        own.append(cov)
        inside += cov * m / n
    factors, offsets = [], []
    for k in (0, 1):
        cov = (1 - pooling) * own[k] + pooling * inside
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / d + 1e-3) * np.eye(d)
        low = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log((got[k][0] + 0.5) / (n + 1)) - np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, means, factors, offsets)


def calibrate(model: Discriminant, x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Platt scaling of the log-density difference, by Newton's method with smoothed targets."""
    if len(y) < 20 or y.min() == y.max():
        return model
    d = np.clip(model.difference(x), -60, 60)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.stack([d, np.ones_like(d)], axis=1)
    w = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - t) + 1e-3 * (w - [0.5, 0])
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), g)
    if w[0] > 0:
        model.slope, model.shift = float(w[0]), float(w[1])
    return model


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text of every row by its statistics, an array ``stats``; a null text counts as an empty one.

    Equal texts have equal statistics; an empty table stays empty; a column named stats is replaced, all others stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=[text]).assign(stats=[statistics(t if isinstance(t, str) else "") for t in pdf[text]])

    docs = docs.drop("stats")
    return docs.mapInPandas(run, docs.drop(text).selectExpr("*", "array(0D) AS stats").schema)


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fits on every labelled row outside the held-out fold; Spark sums the moments, one row per class comes back.

    Null ids and labels other than 0 and 1 are left out, and so is a document with labels that disagree; repeated rows
    count each. Without rows, or with one label alone, scores stay near the prior.
    """
    rows = stats.select("doc_id", "stats").join(agreed(labels, label).where(~held_out(F.col("doc_id"))), "doc_id").select("doc_id", "label", "stats")
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("stats")[i] for i in range(d)]
    got = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("ss")).collect()
    moments = {}
    for r in got:
        ss = np.zeros((d, d))
        for (i, j), v in zip(pairs, r.ss):
            ss[i, j] = ss[j, i] = v
        moments[r.label] = (r.n, np.array(r.s), ss)
    model = fit(moments)
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).select("label", "stats").collect()
    return calibrate(model, np.array([r.stats for r in some]).reshape(-1, d), np.array([r.label for r in some], float))


def score(stats: DataFrame, model: Discriminant, cut: float = 0.7) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted, 1 from ``cut`` on; empty texts get a score as any other.

    Equal statistics score alike; an empty table stays empty; columns of the two names are replaced, all others stay.
    """
    stats = stats.drop("score", "predicted")
    held = stats.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = held.value.score(np.stack(pdf["stats"].to_numpy())) if len(pdf) else np.zeros(0)
            yield pdf.drop(columns=["stats"]).assign(score=s, predicted=(s >= cut).astype(np.int32))

    return stats.mapInPandas(run, stats.drop("stats").selectExpr("*", "0D AS score", "0 AS predicted").schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.7) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) without its text, with score and predicted.

    A null or empty text gets the score of its statistics, as any other. Repeated rows score alike, an empty table stays
    empty, memory is in proportion to the longest text. Input columns named stats, score or predicted are replaced.
    """
    stats = materialise(describe(docs))
    out = materialise(score(stats, train(stats, labels, label), cut))
    release(stats)
    return out
