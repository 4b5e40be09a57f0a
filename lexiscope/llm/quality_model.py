"""Quality classifier: naive Bayes support vectors.

Documents are sets of hashed n-grams: words, pairs of words, and runs of one to three word shapes (case, digits, marks,
whether a word repeats the one before, line ends), each shape also by how large a share of the words it
has. Indicators are scaled by the log ratio of their class frequencies and a linear hinge loss is
minimised over them by dual coordinate descent. Margins become probabilities by a logistic fit over
margins from models that did not see the document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import per_document, rolling
from lexiscope.llm.fitting import platt, remainder, sample, sigmoid

BITS = 20
PER_CLASS = 3000
TOKEN = re.compile(r"\n|[^\s]+")
RUNS = re.compile(r"([a-zß-öø-ÿ]+)|([A-ZÀ-ÖØ-Þ]+)|(\d+)|([^\W\d_]+)|(.)", re.S)
LEVELS = np.array([0.01, 0.05, 0.2, 0.5])


def shape(token: str) -> str:
    """Runs of letters by case and digits become one sign each; marks stay, up to three alike."""
    if token == "\n":
        return token
    out: list[str] = []
    for low, up, digit, other, mark in RUNS.findall(token):
        out.append("a" if low else "A" if up else "0" if digit else "x" if other else mark)
    text = re.sub(r"(.)\1{2,}", r"\1\1\1", "".join(out))
    return text + (">" if len(token) > 24 else "")


class Features:
    """Text -> sorted distinct bucket numbers; words and shapes are memoised within bounds."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.word = np.zeros(0, np.uint64)
        self.form = np.zeros(0, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        tokens = TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(1, np.int32)  # a bucket for the empty text
        if len(self.ids) > 300_000:
            self.__init__()
        ids = self.ids
        fresh = [t for t in set(tokens) if t not in ids]
        if fresh:
            for t in fresh:
                ids[t] = len(ids)
            self.word = np.concatenate([self.word, np.array([xxh64_intdigest(t.lower().encode(), 1) for t in fresh], np.uint64)])
            self.form = np.concatenate([self.form, np.array([xxh64_intdigest(shape(t).encode(), 2) for t in fresh], np.uint64)])
        at = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
        form = self.form[at].copy()
        form[1:][at[1:] == at[:-1]] = np.uint64(0x0123456789ABCDEF)  # the same word again
        grams = [self.word[at], rolling(self.word[at], 2)]
        for n in (1, 2, 3):
            if len(form) >= n:
                h = np.full(len(form) - n + 1, n, np.uint64)
                for j in range(n):
                    h = (h ^ form[j : len(form) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(31)
                grams.append(h)
        forms, times = np.unique(form, return_counts=True)
        for level, least in enumerate(LEVELS):
            often = forms[times >= least * len(form)]
            grams.append((often + np.uint64(level + 11)) * np.uint64(0xD6E8FEB86659FD93))
        every = np.concatenate(grams)
        return np.unique((every >> np.uint64(64 - BITS)).astype(np.int32))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss over unit-length rows of scaled indicators."""
    w, alpha, rng = np.zeros(len(ratio)), np.zeros(len(rows)), np.random.default_rng(seed)
    data = []
    for r in rows:
        x = ratio[r]
        norm = np.sqrt((x * x).sum())
        data.append((r, x / norm if norm else x))
    sign = np.where(y == 1, 1.0, -1.0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = data[i]
            if not x.any():
                continue
            gradient = sign[i] * (w[at] @ x) - 1
            new = min(max(alpha[i] - gradient, 0.0), c[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * sign[i] * x
                alpha[i] = new
    return w


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log((p + 1) / |p|) / ((q + 1) / |q|) for each bucket, p and q the documents of each class that have it."""
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for r, t in zip(rows, y, strict=True):
        (p if t == 1 else q)[r] += 1
    return np.log(p / p.sum() * (q.sum() / q))


def fit(rows: list[np.ndarray], y: np.ndarray, rates: dict[int, float]) -> dict:
    """The model: a weight for each bucket, the squared ratios for a row's length, and the logistic fit."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return {"weight": np.zeros(1 << BITS, np.float32), "square": np.zeros(1 << BITS, np.float32), "a": 0.0, "b": float(np.log((share + 0.01) / (1.01 - share)))}
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    c = (len(y) / (2.0 * n))[y]

    def train(keep):
        own = [rows[i] for i in keep]
        r = ratios(own, y[keep])
        return r, descend(own, y[keep], r, c[keep])

    margin = np.zeros(len(y))
    for fold in range(3):
        inside = np.arange(len(y)) % 3 != fold
        r, w = train(np.flatnonzero(inside))
        for i in np.flatnonzero(~inside):
            x = r[rows[i]]
            margin[i] = (w[rows[i]] @ x) / (np.sqrt((x * x).sum()) or 1.0)
    weight = np.array([1 / rates.get(t, 1.0) for t in y])
    a, b = platt(margin, y, weight)
    r, w = train(np.arange(len(y)))
    return {"weight": (w * r).astype(np.float32), "square": (r * r).astype(np.float32), "a": a, "b": b}


def predict(model: dict, row: np.ndarray) -> float:
    margin = float(model["weight"][row].sum()) / (float(np.sqrt(model["square"][row].sum())) or 1.0)
    return sigmoid(model["a"] * margin + model["b"])


def learn(docs: DataFrame, labels: DataFrame, train: F.Column, per_class: int = PER_CLASS, label: str = "quality") -> dict:
    """Fit on about `per_class` labelled rows of each class; only their bucket numbers come to the driver."""
    rows, rates = sample(docs, labels, label, train, per_class)
    features = Features()
    got = per_document(rows, ["doc_id", "text", "y"], lambda i, t, y: {"doc_id": i, "y": y, "x": [features(v).tobytes() for v in t]}, "doc_id long, y int, x binary")
    table = got.toArrow().sort_by("doc_id") if hasattr(got, "toArrow") else pa.Table.from_pandas(got.toPandas())
    x = [np.frombuffer(b, np.int32) for b in table.column("x").to_pylist()]
    return fit(x, np.array(table.column("y").to_pylist(), np.int64), rates)


def score(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, per_class: int = PER_CLASS, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted for every row.

    Labels are read only of rows whose crc32(doc_id) mod `mod` is not `held`. A null or empty text has
    one bucket of its own. Without labels of both classes the score is their share, 0.5 without
    any. Repeated rows stay; a null doc_id is not held out; other columns are ignored; an empty
    table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, remainder("doc_id", mod) != held, per_class, label))
    features = Features()
    out = per_document(docs, ["doc_id", "text"], lambda i, t: {"doc_id": i, "score": [predict(model.value, features(v)) for v in t]}, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
