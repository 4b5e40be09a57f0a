"""Toxicity: averaged subword embeddings under a linear softmax.

A word is the bag of its character n-grams (three to five, with word ends) and itself, each a row of one
hashed table of vectors; a document is the average over its distinct words. Vectors and softmax are
trained together in numpy, with AdaGrad steps over small batches. An unseen misspelling shares most
of its n-grams with the word it stands for, so it scores near it.

The model is linear after the average, so once trained each n-gram is worth one number; scoring adds them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import per_document, rolling
from lexiscope.llm.fitting import monotone, remainder, sample, share_at

BITS, DIM = 17, 8
PER_CLASS = 2000
LONG = 40
KEPT = 500_000
WORD = re.compile(r"[^\W_](?:[\w'@$*!+-]*[^\W_])?")


def words_in(chunk: str) -> list[str]:
    """The words of lower-case text without white space; a longer run is cut into overlapping pieces that together have each of its n-grams."""
    words = WORD.findall(chunk)
    if len(chunk) <= LONG:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w) - 4, LONG - 4)])]


def words_of(text: str | None) -> set[str]:
    """Distinct words."""
    return {w for c in set((text or "").lower().split()) for w in words_in(c)}


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of each n-gram of each word and of each word as a whole."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    line = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(c)) - start[word]
    mixed = (c + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) << np.uint64(32)))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    ids, of = [np.add.reduceat(mixed, start) * np.uint64(0x9E3779B97F4A7C15)], [np.arange(len(words))]
    left = size[word] - place
    for n in (3, 4, 5):
        h = rolling(c, n)
        inside = np.flatnonzero((left[: len(h)] >= n) & (size[word[: len(h)]] > n))
        ids.append(h[inside])
        of.append(word[inside])
    return (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(of)


def bags(texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lists of distinct words -> distinct buckets and their weights: each word has the same say, each of its n-grams an equal part."""
    out = []
    for words in texts:
        ids, of = grams(words)
        if not len(ids):
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        at, back = np.unique(ids, return_inverse=True)
        out.append((at, (np.bincount(back, (1 / np.bincount(of))[of]) / len(words)).astype(np.float32)))
    return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 15, batch: int = 64, rate: float = 1.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(value of each bucket, bias): the difference of the two logits that each bucket adds for a weight of one."""
    rng = np.random.default_rng(seed)
    full = [i for i in range(len(bags)) if len(bags[i][0])]
    # only buckets that occur are worked on
    used = np.unique(np.concatenate([bags[i][0] for i in full])) if full else np.zeros(0, np.int32)
    local = {i: np.searchsorted(used, bags[i][0]) for i in full}
    table = (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    own = table[used]
    seen, soft_seen, bias_seen = np.full(len(used), 1e-8, np.float32), np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - 0.9 * epoch / epochs)
        rng.shuffle(full)
        for at in range(0, len(full), batch):
            part = full[at : at + batch]
            ids = np.concatenate([local[i] for i in part])
            weight = np.concatenate([bags[i][1] for i in part])
            size = np.array([len(bags[i][0]) for i in part])
            hidden = np.add.reduceat(own[ids] * weight[:, None], np.cumsum(size) - size)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ soft.T
            flow = np.repeat(back, size, axis=0) * weight[:, None]
            g = np.stack([np.bincount(ids, flow[:, d], len(used)) for d in range(DIM)], axis=1).astype(np.float32)
            seen += (g * g).mean(axis=1)
            own -= g * (step / np.sqrt(seen))[:, None]
            gs, gb = hidden.T @ p, p.sum(axis=0)
            soft_seen += gs * gs
            soft -= step * gs / np.sqrt(soft_seen)
            bias_seen += gb * gb
            bias -= step * gb / np.sqrt(bias_seen)
    table[used] = own
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), bias


FOLDS = 3


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rates: dict[int, float]) -> dict:
    """The mean of models that each leave a fold of documents out, and the share of toxic documents as a rising function of the margin,
    from the documents left out. none: the share of all, for texts without words."""
    weight = np.array([1 / rates.get(t, 1.0) for t in y.tolist()])
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return {"value": np.zeros(1 << BITS, np.float32), "curve": (np.zeros(1), np.full(1, share)), "none": share}
    fold = np.empty(len(y), np.int64)
    for t in (0, 1):  # each class is dealt out by itself
        fold[y == t] = np.arange((y == t).sum()) % FOLDS
    margin, values = np.zeros(len(y)), []
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        values.append(train([bags[i] for i in inside], y[inside], seed=5 + k)[0])
        for i in np.flatnonzero(fold == k):
            margin[i] = float(values[-1][bags[i][0]] @ bags[i][1])
    return {"value": np.mean(values, axis=0), "curve": monotone(margin, y, weight), "none": share}


def learn(docs: DataFrame, labels: DataFrame, keep: F.Column, per_class: int = PER_CLASS, label: str = "toxic") -> dict:
    """Fit on about `per_class` labelled rows of each class; only their distinct words come to the driver."""
    rows, rates = sample(docs, labels, label, keep, per_class)
    run = lambda i, t, y: {"doc_id": i, "y": y, "words": [" ".join(sorted(words_of(v))) for v in t]}
    table = per_document(rows, ["doc_id", "text", "y"], run, "doc_id long, y int, words string").toArrow().sort_by("doc_id")
    return fit(bags([w.split() for w in table.column("words").to_pylist()]), np.array(table.column("y").to_pylist(), np.int64), rates)


class Scorer:
    """Values of words under a model, memoised within bounds by the white-space chunks that hold them."""

    def __init__(self, model: dict):
        self.model = model
        self.words: dict[str, float] = {}
        self.chunks: dict[str, str | tuple[str, ...]] = {}

    def learn(self, fresh: set[str]) -> None:
        """Find the words of chunks, and the values of new words all at once."""
        every: set[str] = set()
        for c in fresh:
            w = words_in(c)
            every.update(w)
            self.chunks[c] = w[0] if len(w) == 1 else tuple(w)
        new = list(every.difference(self.words))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids, of = grams(part)
            self.words.update(zip(part, (np.bincount(of, self.model["value"][ids]) / np.bincount(of)).tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[float]:
        if len(self.words) > KEPT or len(self.chunks) > KEPT:
            self.words.clear()
            self.chunks.clear()
        split = [set((t or "").lower().split()) for t in texts]
        fresh = set().union(*split).difference(self.chunks)
        if fresh:
            self.learn(fresh)
        margins = np.full(len(texts), np.nan)
        for i, chunks in enumerate(split):
            words = set(map(self.chunks.__getitem__, chunks))
            for several in [w for w in words if isinstance(w, tuple)]:
                words.remove(several)
                words.update(several)
            if words:
                margins[i] = sum(map(self.words.__getitem__, words)) / len(words)
        return np.where(np.isnan(margins), self.model["none"], share_at(np.nan_to_num(margins), self.model["curve"])).tolist()


def score(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, per_class: int = PER_CLASS, label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted for every row.

    Labels are read only of rows whose crc32(doc_id) mod `mod` is not `held`. A text without words
    (null, empty) has the share of toxic labels. Without labels of both classes the score is that share, 0.5
    without any. Repeated rows stay; a null doc_id is not held out; other columns are ignored; an
    empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, remainder("doc_id", mod) != held, per_class, label))
    held_by_worker: list[Scorer] = []

    def run(i, t):
        if not held_by_worker:
            held_by_worker.append(Scorer(model.value))
        return {"doc_id": i, "score": held_by_worker[0](t)}

    out = per_document(docs, ["doc_id", "text"], run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
