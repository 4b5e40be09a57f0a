"""Very many patterns by their index against the same patterns tried one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.operators import grams as G
from lexiscope.operators import rules as R
from lexiscope.operators import style as S

WORDS = ["alpha", "beta", "gam.ma", "in", "the", "a", "of", "délta", "x*y", "(eta)", "theta", "iot", "漢字", "한국어", "ß"]


def corpus(spark, rng, n=60):
    join = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", ", ", ". "]) for _ in range(k))
    rows = [(i, join(rng.randint(0, 40)).title() if i % 5 == 0 else join(rng.randint(0, 40)), rng.choice(["en", "ko", "xx"]), "s") for i in range(n)] + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "a", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def lexicon(spark, rng, n=150):
    rows = {(rng.choice(["en", "ko"]), kind, entry) for _ in range(n) for kind, entry in [("phrase", rng.choice([" ", " ~ ", "~", "  "]).join(rng.choices(WORDS, k=rng.randint(1, 3)))), ("strict", " ".join(rng.choices(WORDS, k=rng.randint(1, 3))))]}
    return spark.createDataFrame(sorted(rows | {("en", "phrase", "~"), ("en", "phrase", "A ~ B"), ("en", "phrase", "Alpha Beta"), ("en", "strict", "Alpha Beta")}), "lang string, kind string, entry string")


@pytest.mark.parametrize("seed", [1, 2])
def test_indexed_patterns_are_those_of_the_list(spark, seed):
    rng = random.Random(seed)
    u, lex = S.units(corpus(spark, rng).withColumn("text", F.coalesce("text", F.lit(""))), "line", outer=True), lexicon(spark, rng)
    keys = ["doc_id", "para_idx"]
    said = lambda listed: sorted((r["doc_id"], r["para_idx"] or 0, sorted(r["entries"])) for r in R.matched(u, lex, keys, listed=listed).collect())
    by_list = said(10_000)
    assert said(0) == by_list
    assert sum(len(x[2]) for x in by_list) > 100


@pytest.mark.parametrize("seed", [3, 4])
def test_indexed_terms_are_those_of_the_list(spark, seed):
    rng = random.Random(seed)
    docs = corpus(spark, rng)
    terms = spark.createDataFrame([(lang, t) for lang in ("en", "ko") for t in ["in the", "a", "", "ALPHA", "ma\n", "*y ", "漢字", "한국", "nowhere", None, *(rng.choice(WORDS)[1:] for _ in range(12))]], "lang string, term string")
    hits = lambda listed: sorted(map(tuple, R.watch_hits(docs, terms, listed).collect()))
    assert hits(0) == hits(1000) and any(n for _, n in hits(0))
    phrases = docs.select("lang", F.col("text").alias("phrase")).unionByName(spark.createDataFrame([("en", "a"), ("en", "A"), ("ko", "漢字"), ("en", "ß")], "lang string, phrase string"))
    covered = lambda listed: sorted(map(tuple, R.term_coverage(phrases, terms, listed).collect()))
    assert covered(0) == covered(1000)


def test_runs_of_characters_have_numbers_of_their_own():
    text = "aab\x00ab漢字ßé" * 3
    for n in (1, 2, 3):
        assert len(G.runs(text, n)) == len({text[i : i + n] for i in range(len(text) - n + 1)})
    assert set(G.runs("abc", 3)) <= set(G.runs("xxabcxx", 3)) and not len(G.runs("ab", 3)) and not len(np.intersect1d(G.runs("abc", 3), G.runs("bca", 3)))


def test_few_patterns_meet_a_text(spark):
    """Of 5,000 phrases a text meets those that have its rare run of characters, not all."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    phrases = [f"{word()} {word()}" for _ in range(5000)]
    literals = spark.createDataFrame([("en", p, p.split()) for p in phrases], "lang string, entry string, pieces array<string>")
    texts = spark.createDataFrame([(i, "en", f"{word()} {phrases[i]} {word()}") for i in range(200)], "doc_id long, lang string, low string")
    met = G.candidates(texts, ["doc_id"], "low", literals)
    assert met.filter(F.col("entry").isin(phrases[:200])).select("doc_id").distinct().count() == 200
    assert met.count() < 200 * 60
