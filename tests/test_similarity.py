"""Top-k retrieval against all pairs, with small blocks, ties and terms that nothing else has."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiscope.operators import similarity as Y

WORDS = [a + b for a in ("an", "the", "or", "is", "re", "tion", "ed", "ing") for b in ("st", "nd", "er", "ou", "wh", "ble")]


def texts(rng, n, common=3):
    return [" ".join(rng.choices(WORDS[:6], k=common) + rng.choices(WORDS, k=rng.randint(0, 25))) for _ in range(n)]


def by_hand(docs, queries, k, least):
    cut = lambda t: Counter([w for w in t.split() if w] + [g for g in map("".join, zip(t, t[1:], strict=False)) if g.strip(" \t\n\v\f\r")])
    bags = {i: cut(t) for i, t in docs if t is not None}
    df = Counter(t for c in bags.values() for t in c)
    weight = {t: math.log((len(bags) + 1) / (n + 1)) + 1 for t, n in df.items()}

    def vector(c):
        v = {t: (1 + math.log(f)) * weight[t] for t, f in c.items() if t in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    vectors, out = {i: vector(c) for i, c in bags.items()}, {}
    for q, t in queries:
        v = vector(cut(t))
        scores = sorted((-math.floor(sum(x * d.get(t, 0) for t, x in v.items()) * 1e5 + 0.5) / 1e5, i) for i, d in vectors.items())
        out |= {(q, i): (-s, n + 1) for n, (s, i) in enumerate(scores[:k]) if -s >= least}
    return out


@pytest.mark.parametrize("block, k", [(200, 3), (2_000_000, 3), (1000, 12)])
def test_retrieval_matches_all_pairs(spark, block, k):
    rng = random.Random(block + k)
    docs = list(enumerate([*texts(rng, 150), None, "", "anst", "anst"]))
    docs += [(200, docs[3][1]), (201, docs[3][1])]  # ties
    queries = list(enumerate([*texts(rng, 12), docs[3][1], "zzz qqq", "anst"]))
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    d, q = frame(docs, "doc_id"), frame(queries, "query")
    counted = Y.frequencies(d, "doc_id")
    w = Y.idf(d, "doc_id", counted=counted)
    index, asked = Y.tfidf(d, w, "doc_id", counted=counted), Y.tfidf(q, w, "query")
    got = {(r["query"], r["doc_id"]): (r["score"], r["rank"]) for r in Y.retrieve(asked, index, k, 0.3, block=block).collect()}
    want = by_hand(docs, queries, k, 0.3)
    assert got.keys() == want.keys()
    assert all(abs(got[p][0] - want[p][0]) < 2e-5 and got[p][1] == want[p][1] for p in want)


def test_few_documents_are_scored_whole(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(texts(rng, 800))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    w = Y.idf(d, "doc_id")
    said = Y.scored_blocks(Y.tfidf(d.filter("doc_id < 20").withColumnRenamed("doc_id", "query"), w, "query"), Y.tfidf(d, w, "doc_id"), 3, 0.05, "query", "doc_id", Y.BLOCK)[1]
    scored, every = said.agg(F.sum("scored"), F.sum("documents")).first()
    assert every == 20 * 800 and scored < every / 10


def test_terms_in_python_are_those_of_the_expression(spark):
    odd = ["", " ", "a", "a b", " x y　z", "\x0b\x0c q", "\x1c\x1d\x85", "é́ 漢字", "tab\tand\r\nline", "😀 x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, text string").select("id", "text", Y.terms("text").alias("terms")).collect()
    for r in rows:
        assert sorted(Y.words_and_bigrams(r["text"])) == sorted(r["terms"])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, term string, w double")
    some = spark.createDataFrame([(1, "a", 1.0)], "query long, term string, w double")
    assert Y.retrieve(some, none).count() == 0
    assert Y.retrieve(some.limit(0), none.unionAll(spark.createDataFrame([(1, "a", 1.0)], none.schema))).count() == 0
