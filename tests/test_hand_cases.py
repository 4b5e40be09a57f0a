"""Small cases worked out by hand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators import curation as C
from lexiscope.operators import evaluation as E
from lexiscope.operators import model as M
from lexiscope.operators import pairs as P
from lexiscope.operators import rules as R
from lexiscope.operators import similarity as Y
from lexiscope.operators import stats as X
from lexiscope.operators import style as S
from lexiscope.operators import verdicts as V


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<int>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize(
    "text, want",
    [("one\n\ntwo\n\n\nthree", ["one", "two", "three"]), ("", []), (None, []), (" \n \n x \n", ["x"])],
)
def test_paragraphs(spark, text, want):
    assert one(spark, T.split_paragraphs("t"), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("First. Second! Third?\nFourth", ["First", "Second", "Third", "Fourth"]), ("彼は「やめろ。」と言った。次。", ["彼は「やめろ。」と言った", "次"]), ("3.5 is it...", ["3.5 is it"])],
)
def test_sentences(spark, text, want):
    assert one(spark, T.split_sentences("t"), t=text) == want


def test_list_blocks(spark):
    text = "Intro:\nfirst\nsecond\nthird"
    assert one(spark, T.strip_list_blocks("t"), t=text) == "Intro:"
    assert one(spark, T.strip_list_blocks("t"), t="Intro:\nonly one") == "Intro:\nonly one"
    assert one(spark, T.strip_list_blocks("t"), t="- a\n2) b\nprose") == "prose"


def test_tokens(spark):
    assert one(spark, T.tokenize("t", F.lit("en")), t="\"don't,\" she said—") == ["don't", "she", "said"]
    assert one(spark, T.tokenize("t", F.lit("ja")), t="カー abc") == ["カ", "ー", "abc"]


def test_transforms(spark):
    assert one(spark, T.zero_width("t"), t="ab cdef") == "ab cd" + T.ZERO_WIDTH + "ef"
    assert one(spark, T.repeat_sentences("t"), t="A b. C") == "A b. A b. CC"
    assert one(spark, T.nfc("t"), t="é") == "é"
    assert one(spark, T.strip_markdown("t"), t="# Title\n\n> quote **bold _x_** [link](http://a) `code` ![i](b)\n- item") == "Title\n\nquote bold x link    \nitem"
    assert one(spark, T.strip_esm("t"), t="import {\n  a,\n} from 'x'\nText\nexport const b = 1\nMore") == "Text\nMore"
    assert one(spark, T.snippet("t", 10), t="One two. Three four. Five") == "One two."
    assert one(spark, T.redact("t"), t="token = abcdefgh12345 me@x.org") == "[redacted] [redacted]"


@pytest.mark.parametrize("counts, want", [([4, 4, 4], 0.0), ([2, 4], 0.333333), ([5], None), ([], None)])
def test_burstiness(spark, counts, want):
    assert one(spark, T.round_half_up(S.cv("c")), c=counts) == want


@pytest.mark.parametrize("text, window, want", [("a b a c", 2, 1.0), ("a a b b", 2, 0.666667), ("a", 2, 1.0)])
def test_mattr(spark, text, window, want):
    assert S.mattr(S.document_units(docs(spark, [text])), ["doc_id"], window).first()["mattr"] == want


def test_mattr_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 80))) for _ in range(20)]
    got = {r["doc_id"]: r["mattr"] for r in S.mattr(S.document_units(docs(spark, texts)), ["doc_id"], 10).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        want = sum(len(set(w[j : j + 10])) / 10 for j in range(len(w) - 9)) / (len(w) - 9) if len(w) >= 10 else len(set(w)) / len(w)
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_longest_run(spark):
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0])], "k int, i int, f boolean")
    assert S.longest_run(df, ["k"], "i", "f").first()["longest_run"] == 3


def test_leakage(spark):
    texts = ["see turn0search1", 'class="navlist"', 'turn0search1 class="navlist"', "I am an AI researcher", "As an AI language model, no", None]
    got = [(r["leaked"], r["n_rules"]) for r in R.markup_leakage(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(True, 1), (False, 0), (True, 2), (False, 0), (True, 1), (False, 0)]


def test_candour_and_breaks(spark):
    got = [(r["count"], r["hot"]) for r in R.candour(docs(spark, ["Here's the thing.", "Real talk: here's the thing", None])).orderBy("doc_id").collect()]
    assert got == [(1, False), (2, True), (0, False)]
    texts = ["Title\n---\n\n---\n\n---", "a\n\n***\n\n# H\n\n***\nb\n\n***", "---\nkey: v\n---\n\n---", "none"]
    got = [(r["count"], r["before_heading"], r["hot"]) for r in R.thematic_breaks(docs(spark, texts).select("doc_id", "text"), ["doc_id"]).orderBy("doc_id").collect()]
    assert got == [(2, 0, False), (3, 1, True), (1, 0, False), (0, 0, False)]


def test_lexicon(spark):
    u = S.units(docs(spark, ["It leverages data", "not only fast but good", "a state-of-the-art thing", "nothing here"]))
    lex = spark.createDataFrame([("en", "strict", "leverage"), ("en", "phrase", "not only ~ but"), ("en", "strict", "state-of-the-art"), ("en", "strict", "her")], "lang string, kind string, entry string")
    assert sorted((r["doc_id"], r["entry"]) for r in R.match_terms(u, lex, ["doc_id"]).collect()) == [(0, "leverage"), (1, "not only ~ but"), (2, "state-of-the-art")]
    dense = {r["doc_id"]: (r["density"], r["lexicon_hot"]) for r in R.lexicon_density(u, lex, ["doc_id"]).collect()}
    assert dense[0] == (pytest.approx(333.333333), True) and dense[3] == (0.0, False)


@pytest.mark.parametrize("row, want", [((20.0, 60.0, 0.0, False), (60.0, "divergence")), ((0.0, 0.0, 90.0, True), (90.0, "evidence-floor")), ((20.0, 100.0, 0.0, True), (20.0, None)), ((20.0, 30.0, 0.0, False), (20.0, None))])
def test_reconcile(spark, row, want):
    r = V.reconcile(spark.createDataFrame([row], "external double, deterministic double, floor double, skipped boolean")).first()
    assert (r["overall"], r["reason"]) == want


def test_category_scores(spark):
    sizes = {"content": 6, "language": 9, "style": 7, "communication": 4, "filler": 6, "structure": 5, "viral-hook": 9}
    pats = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    hits = [("content0", 6), ("content1", 3), ("content2", 1), ("language0", 3), ("style0", 6), ("filler0", 1), ("structure0", 6)]
    df = spark.createDataFrame([(1, "d", p, n, False) for p, n in hits], "doc_id int, doc_type string, pattern string, instances int, is_short boolean")
    w = spark.createDataFrame([("content", 0.18), ("language", 0.18), ("style", 0.18), ("communication", 0.13), ("filler", 0.08), ("structure", 0.15), ("viral-hook", 0.10)], "category string, weight double")
    out = V.category_scores(df, spark.createDataFrame(pats, "pattern string, category string"), w, spark.createDataFrame([], "doc_type string, pattern string, action string")).first()
    assert out["overall"] == pytest.approx(13.349, abs=1e-3)


@pytest.mark.parametrize("k, n, want", [(9, 10, (0.5958, 0.9821)), (404, 600, (0.6348, 0.7097)), (32, 200, (0.1157, 0.2171))])
def test_wilson(spark, k, n, want):
    low, high = E.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(float(k), float(n))], "k double, n double").select(low, high).first()
    assert (r[0], r[1]) == (pytest.approx(want[0], abs=1e-4), pytest.approx(want[1], abs=1e-4))


def test_ranking(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "score double, expected boolean")
    assert E.roc_auc(df).first()["auc"] == 0.875
    assert E.average_precision(df).first()["ap"] == pytest.approx(0.8333, abs=1e-4)
    assert X.cliffs_delta(df).first()["delta"] == 0.75
    r = E.tpr_at_fpr(df, [0.05]).first()
    assert (r["tpr"], r["threshold"]) == (0.5, 0.9)


def test_latency(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "ms double").withColumn("g", F.lit(1))
    r = E.latency_summary(df, "ms", ["g"]).first()
    assert (r["p50"], r["p95"]) == (10.0, 19.0)


def test_studies(spark):
    df = spark.createDataFrame([(u, float(v)) for u, vs in enumerate([(1, 2), (3, 3), (5, 4)]) for v in vs], "unit int, v double")
    assert X.krippendorff(df, "unit", "v").first()["alpha"] == pytest.approx(0.8333, abs=1e-4)
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0])], "g int, v array<double>")
    assert X.cohesion(vec, "v", ["g"]).first()["cohesion"] == pytest.approx(0.4714, abs=1e-4)
    panel = spark.createDataFrame([(1, "a", 40.0), (1, "b", 60.0), (1, "c", None), (2, "a", 5.0)], "item int, judge string, v double")
    assert {r["item"]: r["score"] for r in X.panel_score(panel, "item", "judge", "v").collect()} == {1: 50.0, 2: None}
    sample = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v"))
    r = X.bootstrap_ci(sample, "v", 200).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.2


def test_number_safety_and_proxy(spark):
    rows = [(1, "en", "1,200 items in 3 days", "1200 items"), (2, "en", "a b", "a b"), (3, "en", "we do not ship never", "we ship"), (4, "en", "alpha beta gamma delta words here today", "x"), (5, None, "5 km", "5 kg"), (6, "en", None, "7"), (7, "en", "it is $5", "it is $5")]
    pairs = spark.createDataFrame(rows, "id int, lang string, original string, rewrite string")
    got = {r["id"]: (r["missing"], r["added"], r["safe"], r["reason"]) for r in P.number_safety(pairs, "id").collect()}
    assert got == {1: (1, 0, False, "numeric_claim_changed"), 2: (0, 0, True, None), 3: (0, 0, True, None), 4: (0, 0, True, None), 5: (1, 1, False, "numeric_claim_changed"), 6: (0, 1, False, "numeric_claim_changed"), 7: (0, 0, False, "ambiguous_numeric_syntax")}
    assert P.dropped_numbers(pairs).filter("id = 1").first()["dropped"] == ["3"]
    proxy = {r["id"]: (r["severity"], r["reasons"]) for r in P.meaning_proxy(pairs, "id").collect()}
    assert proxy == {1: ("fail", "numbers,terms"), 2: ("pass", ""), 3: ("fail", "terms,negation"), 4: ("fail", "terms,length"), 5: ("fail", "numbers"), 6: ("fail", "numbers,length"), 7: ("fail", "numbers")}
    claims = {r["id"]: (r["claims"], r["reason"]) for r in P.numeric_claims(pairs, ["id"], "original").collect()}
    assert claims[1] == (["number:1200/1", "number:3/1"], None) and claims[7] == ([], "ambiguous_numeric_syntax") and claims[6] == ([], None)


def test_rare_token_recall(spark):
    rng = random.Random(5)
    words = ["alpha", "be", "gamma", "漢", "de", "a", "omega"]
    rows = [(i, "en", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(40)] + [(99, "en", None, None)]
    for r in P.rare_token_recall(spark.createDataFrame(rows, "id int, lang string, original string, rewrite string"), "id").collect():
        _, _, o, t = next(x for x in rows if x[0] == r["id"])
        tokens = lambda x: [w for w in (x or "").split() if len(w) >= 2 or w == "漢"]
        rare = [w for w in set(tokens(o)) if tokens(o).count(w) <= 2]
        kept = sum(w in tokens(t) or (len(w) >= 5 or w == "漢") and w in (t or "") for w in rare)
        assert (r["rare"], r["survived"]) == (len(rare), kept) and (r["recall"] is None) == (len(rare) < 3)


def test_rewrite_quality(spark):
    rows = [(60.0, 20.0, 4, 4, 1.0), (60.0, 40.0, 4, 4, 0.6), (60.0, 20.0, 4, 2, 1.0), (20.0, 40.0, 0, 0, 1.0), (60.0, 20.0, 0, 0, 0.2), (60.0, 20.0, 0, 0, 1.8)]
    df = spark.createDataFrame(rows, "before double, after double, facts int, kept int, ratio double")
    assert [(r["safety"], r["gain"], r["quality"]) for r in P.rewrite_quality(df).collect()] == [(100.0, 40.0, "pass"), (80.0, 16.0, "warn"), (50.0, 20.0, "fail"), (100.0, 0.0, "fail"), (30.0, 12.0, "fail"), (60.0, 24.0, "fail")]


def test_persona_penalties(spark):
    targets = spark.createDataFrame([("p", "mattr", 0.8, 0.1, 1.0), ("p", "lexicon_density_avoid", 2.0, 1.0, 1.0), ("p", "overEditChurn", 0.4, 0.0, 0.0)], "persona_id string, feature string, target double, tolerance double, weight double")
    names = ["mattr", "lexicon_density_avoid"]
    rows = [(1, 0.8, 2.0, 0.4), (2, 0.8, 5.0, 0.4), (3, 0.8, 2.0, 0.6), (4, 0.8, 2.0, None)]
    got = {r["doc_id"]: r["score"] for r in P.persona_match(spark.createDataFrame(rows, "doc_id int, mattr double, lexicon_density_avoid double, churn double"), names, targets).collect()}
    assert got[1] == got[4] == 100.0 and got[3] == pytest.approx(90.0)
    distance = math.sqrt(9 / 2)
    cosine = (0.8 * 0.8 + 5 * 2) / math.sqrt((0.64 + 25) * (0.64 + 4))
    assert got[2] == pytest.approx(80 * (1 - distance / 3) + 20 * cosine - 10, abs=1e-3)


def test_thresholds_from_the_lowest_quarter(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (91, 88.9, 75.5, 60, 99, 80, 85, 77)] + [("b", 72.5), ("c", 40.0), ("c", None)], "k string, v double")
    assert {r["k"]: (r["n"], r["threshold"]) for r in P.recommend_thresholds(df, "k", "v").collect()} == {"a": (8, 75.0), "b": (1, 72.0), "c": (1, 70.0)}


def test_seven_signals(spark):
    text = "그는 집에 간다. 나는 밥을 먹는다. 그는 책을 읽는다. 나는 물을 마신다. 그는 길을 걷는다. 나는 글을 쓴다. 그는 꿈을 꾼다."
    lex = spark.createDataFrame([("ko", "strict", "없는말")], "lang string, kind string, entry string")
    r = V.paragraph_verdicts(docs(spark, [text], "ko"), lex).first()
    assert r["hot"] and r["ending_hot"] and not r["lexicon_hot"]
    other = V.paragraph_verdicts(docs(spark, [text], "en"), lex).first()
    assert not other["ending_hot"] and not other["diagnostic_hot"]
    scores = {r["doc_id"]: r for r in V.document_scores(V.paragraph_rows(docs(spark, ["", None, "a b c"]), lex)).collect()}
    assert [scores[i]["n_paragraphs"] for i in range(3)] == [0, 0, 1] and scores[0]["hot_ratio"] == 0.0


def test_lexicon_lists_and_joins_agree(spark):
    rng = random.Random(9)
    words = ["data", "leverage", "robust", "state of the art", "deep dive", "xs"]
    u = S.units(docs(spark, [" ".join(rng.choice([*words, "leverages", "xsing", "x", "Deep  dive"]) for _ in range(rng.randint(0, 9))) for _ in range(25)]))
    lex = spark.createDataFrame([("en", "strict", w) for w in words] + [("en", "phrase", "data ~ robust"), ("de", "strict", "x")], "lang string, kind string, entry string")
    both = [sorted((r["doc_id"], r["entry"]) for r in R.match_terms(u, lex, ["doc_id", "para_idx"], n).collect()) for n in (2000, 0)]
    assert both[0] == both[1] and len(both[0]) > 20


def test_churn(spark):
    row = dict(a="the cat sat on the mat", b="the cat is on a mat")
    assert one(spark, P.edit_churn("a", "b"), **row) == pytest.approx(1 / 3) == one(spark, P.edit_churn("a", "b", "sum"), **row)
    rng = random.Random(2)
    for _ in range(50):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert P.lcs(x, y) == len(P.aligned(x, y))


def test_diffs(spark):
    pairs = spark.createDataFrame([(1, "a\n\nb\n\nc", "a\n\nx\n\nc\n\nd")], "id int, original string, rewrite string")
    assert [(r["kind"], r["before"], r["after"]) for r in P.diff(pairs, "id", "block").orderBy("seq").collect()] == [("same", "a", "a"), ("changed", "b", "x"), ("same", "c", "c"), ("added", "", "d")]
    words = spark.createDataFrame([(1, "the big cat", "the cat sat")], "id int, original string, rewrite string")
    assert [(r["kind"], r["before"], r["after"]) for r in P.diff(words, "id", "word").orderBy("seq").collect()] == [("same", "the", "the"), ("removed", "big", ""), ("same", "cat", "cat"), ("added", "", "sat")]
    split = spark.createDataFrame([(1, "one long block of text here", "one long block\nof text here")], "id int, original string, rewrite string")
    r = P.align_blocks(split, "id").first()
    assert (r["i"], r["j"]) == (0, 0)


def test_blocks_align_at_any_distance():
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(30))
    a = [text() for _ in range(9)]
    b = [text() for _ in range(8)] + a[:4] + [text() for _ in range(7)] + a[4:]
    want = [(i, b.index(x)) for i, x in enumerate(a)]
    assert [(i, j) for i, j, _ in P.paired(a, b, 0.25)] == want
    whole = sum(s for *_, s in P.paired(a, b, 0.25))
    cells, P.CELLS = P.CELLS, 12
    try:
        assert sum(s for *_, s in P.paired(a, b, 0.25)) == pytest.approx(whole)
    finally:
        P.CELLS = cells
    assert P.paired([], b, 0.25) == []


def test_running_sums(spark):
    from lexiscope.operators.ordering import running

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), float(v), rng.randint(0, 5)) for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5)
    for down in (False, True):
        for r in running(df, ["g"], "v", {"before": F.col("n")}, down).collect():
            assert r["before"] == sum(n for g, v, n in rows if g == r["g"] and (v > r["v"] if down else v < r["v"]))
    assert sorted(r["k"] for r in running(df, [], "v", {"k": F.lit(1)}).collect()) == list(range(300))


def test_cohesion_of_groups(spark):
    rng = random.Random(7)
    rows = [(i, int(i < 12), [rng.gauss(1.0 if i < 12 and j == 0 else 0.0, 0.4) for j in range(5)]) for i in range(40)] + [(40, 0, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    groups = {r["g"]: r["cohesion"] for r in X.cohesion(df, "v", ["g"]).collect()}
    r = X.cohesion_test(df, "v", F.col("g") == 1, "id", 20).first()
    assert (r["inside"], r["outside"]) == (groups[1], groups[0]) and 1 / 21 - 1e-9 <= r["p"] <= 0.1


def test_pick_winner(spark):
    df = spark.createDataFrame([(1, "A", 20.0, 60.0, 90.0, 0.1), (1, "B", 30.0, 90.0, 90.0, 0.3), (1, "C", 30.0, 95.0, 90.0, 0.2)], "item int, config string, score double, mps double, fidelity double, churn double")
    assert P.pick_winner(df, "item").first()["config"] == "C"


def test_select_iteration(spark):
    df = spark.createDataFrame([(1, 1, 80.0, 60.0, 90.0, 90.0, 50.0), (1, 2, 60.0, 20.0, 40.0, 90.0, 30.0)], "item int, iteration int, before double, after double, fidelity double, mps double, combined double")
    r = P.select_iteration(df, "item").first()
    assert (r["stop"], r["reason"], r["score"], r["iteration"]) == (2, "fidelity-floor", 60.0, 1)


def test_similarity(spark):
    w = Y.idf(docs(spark, ["aa", "bb", "cc"]), "doc_id")
    assert {r["term"]: round(r["idf"], 4) for r in w.collect()}["aa"] == 1.6931
    assert Y.dice(spark.createDataFrame([(1, "night", "nacht")], "id int, a string, b string"), "id", "a", "b").first()["dice"] == 0.25


def test_takes(spark):
    df = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("a3", "a"), ("b1", "b")], "id string, g string")
    assert [r["id"] for r in C.balanced_take(df, 3, "g", ["id"]).collect()] == ["a1", "b1", "a2"]
    conv = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([9000, 4000, 5000])], "conv_id int, turn int, text string")
    assert sorted(r["turn"] for r in C.trim_context(conv).collect()) == [1, 2]
    rows = spark.range(95).select(F.col("id"))
    assert sorted(r["id"] for r in C.systematic_sample(rows, 20, F.floor(F.col("id") / 7), ["id"]).collect()) == [19, 39, 59, 79]


def test_refuses_rows_with_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, ["bad"])], "id int, errors array<string>")
    with pytest.raises(ValueError):
        C.write_if_clean(df, str(tmp_path / "x"))
    C.write_if_clean(df.withColumn("errors", F.expr("cast(array() as array<string>)")), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1


def test_segments(spark):
    rows = [("no", None, "yes", "final", "a", "b"), (None, None, None, "new", "a", "b"), (None, None, None, None, "a", "<b>x</b>"), (None, None, None, None, "a", " "), (None, None, None, None, "same text", "same text "), (None, None, None, None, "a", "two words"), (None, None, None, "final", "a", "this is a full sentence")]
    df = spark.createDataFrame(rows, "translate string, locked string, approved string, state string, source string, target string")
    assert [r["reason"] for r in C.classify_segments(df).collect()] == ["locked", "state_not_allowlisted", "inline_markup", "empty_target", "untranslated", "not_prose", None]


def test_model(spark):
    with pytest.raises(ValueError):
        M.Model((1.0,), 0.0, (0.0,), (1.0,), 0.5)
    df = spark.createDataFrame([(float(i), i > 5, False) for i in range(10)], "x double, y boolean, expected boolean").withColumn("score", F.col("x") / 10)
    assert M.threshold_for_fpr(df, 0.1).first()["threshold"] == pytest.approx(0.8)
    assert M.verdict(df, None).first()["model_hot"] is None
    m = M.train(df.select(*[F.col("x").alias(f) for f in S.FEATURES], "y"), "y")
    p = df.select(*[F.col("x").alias(f) for f in S.FEATURES], "y").select(M.predict(m).alias("p"), "y").collect()
    assert all((r["p"] > 0.5) == r["y"] for r in p) and all(math.isfinite(r["p"]) for r in p)


def test_unseen_keys_by_digest(spark):
    df = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, None, "x"), (4, "a", "b"), (4, "a", "b")], "id int, k string, text string")
    done = spark.createDataFrame([("ab", "c"), (None, "x"), ("a", "b"), ("a", "b")], "k string, text string")
    out = C.unseen_keys(df, done, ["k", "text"])
    assert sorted(r["id"] for r in out.collect()) == [1, 3] and out.columns == df.columns
    plan = C.unseen_keys(df, done, ["k", "text"]).select("id")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert exchanges and not any("text" in line for line in exchanges)
