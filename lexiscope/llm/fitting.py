"""Bounded labelled samples, held-out rows and calibration, for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 30


def remainder(doc_id: str, mod: int) -> F.Column:
    """crc32(doc_id as text) mod `mod`; null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, bound: int) -> tuple[DataFrame, dict[int, float]]:
    """About `bound` training rows of each class as (doc_id, text, y), drawn by a hash, and the share drawn of each class.

    labels(doc_id, label) count where the label is 0 or 1; a doc_id with both counts as 1. The draw bounds
    the ids by itself, whatever the size of the tables: about `bound` of each class, so they are broadcast."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(train).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, bound / n) for y, n in counts.items()}
    drawn = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(GRAIN))
    chosen = known.filter(F.expr("false") if not rates else F.coalesce(*[F.when(F.col("y") == y, drawn < int(r * GRAIN)) for y, r in rates.items()]))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return rows.select("doc_id", "text", F.col("y").cast("int").alias("y")), rates


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a margin + b) by weighted Newton steps, with the usual softened targets."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    if not len(y) or pos == 0 or neg == 0:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    hi, lo = ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2)
    t = np.where(y == 1, hi, lo)
    scale = margin.std() or 1.0
    x, a, b = margin / scale, 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        H = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(H, np.array([(g * x).sum(), g.sum()]))
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a / scale), float(b)


def monotone(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, shares): the weighted share of class 1 as a rising function of the margin, by pooling adjacent violators.

    Unlike a logistic curve it isn't bent by a few margins far out. A pool's share is drawn a little to the share of all."""
    if not len(y):
        return np.zeros(1), np.full(1, 0.5)
    whole = float((weight * y).sum() / weight.sum())
    pools: list[list[float]] = []  # weight of class 1, weight, weighted sum of margins
    for i in np.argsort(margin, kind="stable").tolist():
        pools.append([weight[i] * y[i], weight[i], weight[i] * margin[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    one, n, m = np.array(pools).T
    return m / n, np.maximum.accumulate((one + whole) / (n + 1))


def share_at(x: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The curve of monotone() between its pools, with a slight slope throughout, so that different margins differ in their scores."""
    at, share = curve
    spread = float(at[-1] - at[0]) or 1.0
    return 0.99 * np.interp(x, at, share) + 0.01 / (1 + np.exp(-np.clip(4 * (x - at.mean()) / spread, -35, 35)))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))
