"""A quality classifier learned from preferences: Bradley-Terry scores by logistic loss on feature differences.

Each pair prefers a document labelled good to one labelled bad; the probability that the first wins is the
logistic of its score minus the other's, and a score is linear in the text's features. The threshold is a
quantile of the training scores: the one whose cut agrees best with the labels. The result's score is the
logistic of the distance to it.

Defined cases: null and empty texts have zero features and are scored like any other; without labels of both
kinds a fixed model that prefers plain prose is used; rows that repeat are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesets import blocks
from .labelled import held_out, training_rows
from .textstats import FEATURES, features


def _wide(x: np.ndarray) -> np.ndarray:
    """Features and the squares of their distances, so a good range in the middle can be learned."""
    return np.hstack((x, np.sqrt(np.abs(x)), x * x))


class Ranker:
    """Linear scores on standardised features; `cut` is the threshold, `scale` stretches the distance to it."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weight: np.ndarray, cut: float, scale: float):
        self.centre, self.spread, self.weight, self.cut, self.scale = centre, spread, weight, cut, scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((_wide(x) - self.centre) / self.spread, -6, 6) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.raw(x) - self.cut), -30, 30)))


def default_ranker() -> Ranker:
    weight = np.zeros(3 * len(FEATURES))
    for name in ("symbols", "bars", "bangs", "upper", "dup_lines", "repeats", "same"):
        weight[FEATURES.index(name)] = -1.0
    return Ranker(np.zeros(len(weight)), np.ones(len(weight)), weight, -0.6, 4.0)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, steps: int = 30, seed: int = 11) -> Ranker:
    """Fit on `pairs` preferences drawn with a fixed seed from rows with labels y (1 preferred to 0)."""
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return default_ranker()
    z = _wide(x)
    centre, spread = z.mean(axis=0), z.std(axis=0) + 1e-6
    z = np.clip((z - centre) / spread, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):  # Newton on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    # Right answers if the lowest k scores are called bad, for each k; the middle of the best run of quantiles.
    right = np.concatenate(([0], np.cumsum(y[order] <= 0))) + (y > 0).sum() - np.concatenate(([0], np.cumsum(y[order] > 0)))
    k = int(np.argmax(right))
    low, high = s[order[max(0, k - 1)]], s[order[min(k, len(s) - 1)]]
    cut = float((low + high) / 2)
    return Ranker(centre, spread, w, cut, 1.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0)):
            x = features(block)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.record_batch([batch.column(1).slice(block.first, block.n), lists], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Ranker:
    """Learn from at most `most_rows` labelled documents; only their feature rows reach the driver."""
    rows = training_rows(docs, labels, "quality", most_rows).select("text", "y").mapInArrow(_features, "y double, x array<double>").toPandas()
    if not len(rows):
        return default_ranker()
    y, x = rows["y"].to_numpy(dtype=float), np.array(rows["x"].tolist(), dtype=float)
    order = np.lexsort((*x.T, y))
    return fit_pairs(x[order], y[order])


def scorer(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(block.first, block.n), pa.array(ranker.score(features(block)))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    scored = docs.select("doc_id", "text").mapInArrow(scorer(fit(docs, labels, most_rows)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
