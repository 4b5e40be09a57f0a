"""Retrieval by TF-IDF over an inverted index, and bigram overlap."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.functions.text import round_half_up as r6
from lexiscope.session import materialise

BLANK = re.compile(r"\s+", re.ASCII)


def terms(c: str | Column) -> Column:
    """White-space words and all character bigrams that aren't blank."""
    x = T.col(c)
    n = F.char_length(x)
    bigrams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(T.non_empty(F.split(x, r"\s+", -1)), F.filter(bigrams, lambda b: ~b.rlike(r"^\s+$")))


def frequencies(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, term, f of every document with a text, written once: documents are cut and counted where they lie, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(words_and_bigrams(t)) for t in b.column(1).to_pylist()]
            size = [len(c) for c in found]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), size))), pa.array([t for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64()),
            ], ["key", "term", "f"])

    x = docs.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("string"))
    kind = x.schema["key"].dataType.simpleString()
    return materialise(x.mapInArrow(run, f"key {kind}, term string, f long")).withColumnRenamed("key", key)


def words_and_bigrams(text: str) -> list[str]:
    """The terms of terms(), in Python: only the white space of ASCII cuts words and makes a bigram blank."""
    return [w for w in BLANK.split(text) if w] + [g for g in map("".join, zip(text, text[1:], strict=False)) if g.strip(" \t\n\v\f\r")]


def idf(docs: DataFrame, key: str, column: str = "text", counted: DataFrame | None = None) -> DataFrame:
    """term, idf = ln((N + 1) / (df + 1)) + 1 over documents with a text; `counted` has their frequencies if they are at hand."""
    n = docs.filter(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    df = (frequencies(docs, key, column) if counted is None else counted).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row


def tfidf(docs: DataFrame, weights: DataFrame, key: str, column: str = "text", counted: DataFrame | None = None) -> DataFrame:
    """key, term, w = (1 + ln f) idf, scaled so that a document's vector has length one. Terms without a weight go."""
    f = frequencies(docs, key, column) if counted is None else counted
    v = f.join(weights, "term").select(key, "term", ((1 + F.log("f")) * F.col("idf")).alias("v"))
    whole = Window.partitionBy(key)  # the terms of one document
    return v.select(key, "term", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(whole))).alias("w"))


#: Postings of the documents, and of the queries, that one task holds.
BLOCK = 2_000_000
#: A query's terms are taken by weight until what is left of it has this length; then documents that can't reach the k-th score go.
STEPS = (0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05)


class Postings:
    """The vectors of a block of documents, by document and by term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray):
        self.keys, row = np.unique(doc, return_inverse=True)
        self.terms, col = np.unique(term, return_inverse=True)
        order = np.argsort(row, kind="stable")
        self.col, self.by_row = col[order], w[order]
        self.row_at = np.searchsorted(row[order], np.arange(len(self.keys) + 1))
        order = np.argsort(col, kind="stable")
        self.row, self.by_col = row[order], w[order]
        self.col_at = np.searchsorted(col[order], np.arange(len(self.terms) + 1))

    def best(self, term: np.ndarray, w: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The rows and scores of the k nearest documents (score, then key) of at least `least`, and how many were scored whole.

        Terms come by weight. What a document has so far is a lower bound of its score, so the k-th largest bounds the k-th
        score from below; by Cauchy and Schwarz the rest of a document adds at most the length of the rest of the query
        times that of the rest of the document."""
        place = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        length = float((w * w).sum())
        here = self.terms[place] == term
        place, w = place[here], w[here]
        length -= length - float((w * w).sum())  # terms that no document here has add nothing
        order = np.argsort(-w, kind="stable")
        place, w = place[order], w[order]
        rest = np.sqrt(np.maximum(length - np.concatenate([[0], np.cumsum(w * w)]), 0))
        n = len(self.keys)
        score, seen, alive, at = np.zeros(n), np.zeros(n), np.ones(n, bool), 0
        for step in (*STEPS, 0.0):
            to = max(at, int(np.searchsorted(-rest, -step)))
            to = min(to, len(w))
            for p, q in zip(place[at:to].tolist(), w[at:to].tolist(), strict=True):
                rows, x = self.row[self.col_at[p] : self.col_at[p + 1]], self.by_col[self.col_at[p] : self.col_at[p + 1]]
                score[rows] += q * x
                seen[rows] += x * x
            at = to
            floor = max(least, np.partition(score, n - k)[n - k] if n > k else 0) - 1e-5  # scores are compared as rounded to five digits
            alive = score + rest[at] * np.sqrt(np.maximum(1 - seen, 0)) >= floor
            if at == len(w) or alive.sum() <= max(k, n // 16):
                break
        rows = np.flatnonzero(alive)
        if at < len(w):  # the documents that are left, by their own terms
            dense = np.zeros(len(self.terms))
            dense[place] = w
            score[rows] = [float(self.by_row[a:b] @ dense[self.col[a:b]]) for a, b in zip(self.row_at[rows].tolist(), self.row_at[rows + 1].tolist(), strict=True)]
        s = np.floor(score[rows] * 1e5 + 0.5) / 1e5
        order = np.lexsort((self.keys[rows], -s))[:k]
        order = order[s[order] >= least]
        return rows[order], s[order], len(rows)


def retrieve(queries: DataFrame, index: DataFrame, k: int = 12, least: float = 0.05, query: str = "query", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """queries(query, term, w), index(key, term, w) -> query, key, score, rank: the k nearest documents of at least the least cosine.

    Vectors have length one and no negative weight; query and key are whole numbers. Documents lie in blocks of about
    `block` postings, and each block meets each block of queries. Within it a query's terms are taken by weight, and a document
    is scored whole only if its bound can still reach the k-th score; each block gives k documents at most for a query."""
    return scored_blocks(queries, index, k, least, query, key, block)[0]


def scored_blocks(queries: DataFrame, index: DataFrame, k: int, least: float, query: str, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The result of retrieve(), and query, block, scored, documents: how many of a block's documents were scored whole."""
    one = lambda df, c: materialise(df.select(F.col(c).cast("long").alias("id"), F.xxhash64("term").alias("term"), F.col("w").cast("double").alias("w")))
    docs, asked = one(index, key), one(queries, query)
    cores = index.sparkSession.sparkContext.defaultParallelism
    n, m = max(cores, docs.count() // block + 1), asked.count() // block + 1
    left = docs.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def meet(key, documents: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if documents.num_rows and wanted.num_rows:
            postings = Postings(*[documents.column(c).to_numpy() for c in ("id", "term", "w")])
            wanted = wanted.sort_by("id")
            ids, term, w = (wanted.column(c).to_numpy() for c in ("id", "term", "w"))
            start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(ids)], strict=True):
                rows, score, scored = postings.best(term[a:b], w[a:b], k, least)
                for col, v in zip(out, ([int(ids[a])] * (len(rows) + 1), [*postings.keys[rows].tolist(), None], [*score.tolist(), None], [None] * len(rows) + [scored], [None] * len(rows) + [len(postings.keys)]), strict=True):
                    col.extend(v)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["query", "id", "score", "scored", "documents"])

    met = materialise(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "query long, id long, score double, scored long, documents long"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")  # k rows of each block
    best = met.filter("id is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("query").alias(query), F.col("id").alias(key), "score", "rank"), met.filter("id is null").select("query", "scored", "documents")


def dice(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, dice: twice the shared character bigrams (as bags, case aside) over all of both; equal texts without bigrams have 1, others 0."""

    @F.pandas_udf("struct<n:long,total:long>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            ga, gb = (Counter(map("".join, zip(t or "", (t or "")[1:], strict=False))) for t in (x, y))
            rows.append(((ga & gb).total(), ga.total() + gb.total()))
        return pd.DataFrame(rows, columns=["n", "total"])

    low_a, low_b = F.lower(a), F.lower(b)
    x = pairs.select(key, run(low_a, low_b).alias("g"), (low_a == low_b).alias("same"))
    return x.select(key, r6(F.when(F.col("g.total") > 0, 2.0 * F.col("g.n") / F.col("g.total")).otherwise(F.col("same").cast("double"))).alias("dice"))
