"""One small case for each mended finding of the third round."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope import session
from lexiscope.functions import text as T
from lexiscope.operators import numbers as N
from lexiscope.operators import rules as R
from lexiscope.operators import style as S
from lexiscope.operators import verdicts as V
from lexiscope.plans import evaluation as E


def test_a_half_of_the_repeated_share_goes_up(spark):
    """201 of 400 words are 50.25 %, which is 50.3 as in the SQL; 1000 * (201 / 400) lies below the half."""
    words = [f"w{i}" for i in range(199)] + ["w0"] * 201
    got = spark.createDataFrame([(words,), ([],)], "w array<string>").select(E.repeated("w").alias("score")).collect()
    assert sorted(r["score"] for r in got) == [0.0, 50.3]


def test_a_large_table_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(session, "SPREAD", 0)
    pq.write_table(pa.table({"doc_id": list(range(400)), "text": ["a line of text"] * 400}), tmp_path / "documents.parquet")
    df = session.table(spark, str(tmp_path), "documents")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 150 and sum(sizes) == 400 and df.select("doc_id").distinct().count() == 400


def test_an_even_table_is_read_as_it_lies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SPREAD", 0)
    spark.range(400).selectExpr("id as doc_id", "repeat('a line of text', 10000) as text").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in session.table(spark, str(tmp_path), "documents")._jdf.queryExecution().executedPlan().toString()


def test_lower_case_tokens_are_not_made_anew_for_each_ngram(spark):
    u = spark.createDataFrame([("A b a B a b",), ("",), ("one two",)], "text string").select(T.tokenize("text").alias("tokens"))
    out = S.ngram_redundancy(u, 2).select("redundancy")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(transform(" not in plan
    assert [r[0] for r in out.collect()] == [0.6, None, 0.0]


def test_words_are_cut_at_blanks_and_lose_their_edges(spark):
    cases = {"--foo-bar's,　(béz)!": ["foo-bar's", "béz"], " x﻿y --- 1.5% ": ["x", "y", "1.5"], "...": [], "\U0001d400b-\U0001d401": ["\U0001d400b-\U0001d401"], "": []}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select("text", T.tokenize("text").alias("w"), T.trim(F.col("text")).alias("t")).collect()
    assert {r["text"]: r["w"] for r in rows} == cases
    assert {r["t"] for r in rows} == {"--foo-bar's,　(béz)!", "x﻿y --- 1.5%", "...", "\U0001d400b-\U0001d401", ""}


def test_leaks_are_sought_where_their_hints_stand_and_found_in_any_case(spark):
    cases = {"see OAICITE here": ["oai-citation-markup"], "x Turn0Search12 y": ["model-tool-token"], "return to the turn": [], "As an AI Language Model, I": ["explicit-self-identification"], "i'm AN ai.": ["explicit-self-identification"], "?REF=ChatGPT": ["ai-tracking-param"], "navlist": []}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select("text", F.transform(R.leaks("text"), lambda h: h["rule"]).alias("r")).collect()
    assert {r["text"]: r["r"] for r in rows} == cases


def test_texts_without_figures_are_read_by_their_words_alone(monkeypatch):
    monkeypatch.setattr(N.Reader, "read", None)  # the notations, all of which have a figure
    assert N.claims_of("One apple, ſeven pears", "en") == (["number:1/1", "number:7/1"], None)
    assert N.claims_of("twone", "fr") == (["number:1/1"], None)
    assert N.claims_of("two three", "en") == ([], "unsupported_word_number")
    assert N.claims_of("thırteen", "en") == ([], "unsupported_word_number")
    assert N.claims_of("３", "ja") == ([], "unsupported_numeric_syntax")


def test_dice_shuffles_nothing(spark):
    from lexiscope.operators import similarity as Y

    x = spark.createDataFrame([(1, "Abab", "ab"), (2, "a", "A"), (3, "a", "b"), (4, "", None)], "id long, a string, b string")
    out = Y.dice(x, "id", "a", "b")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["dice"] for r in out.collect()} == {1: 0.5, 2: 1.0, 3: 0.0, 4: None}


def test_lift_counts_before_it_joins(spark):
    x = spark.createDataFrame([(1, True, ["A", "b"]), (2, False, ["a"])], "doc_id long, hot boolean, tokens array<string>")
    got = R.lexicon_lift(x, spark.createDataFrame([("a",), ("a",), ("b",)], "entry string")).select("entry", "hot_docs", "cold_docs").distinct().collect()
    assert {tuple(r) for r in got} == {("a", 1, 1), ("b", 1, 0)}  # an entry that is listed twice counted its documents twice


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_longest_stretches_stay_in_their_row(spark):
    x = spark.createDataFrame([([13, 14, 2, 20, 21, 22],), ([1],), ([],), (None,)], "counts array<int>")
    out = x.select(S.longest_stretch("counts", lambda n: n > 12).alias("n"))
    assert [r["n"] for r in out.collect()] == [3, 0, 0, None] and shuffles(out) == 0


def test_sentences_are_zoomed_in_without_a_join(spark):
    x = spark.createDataFrame([(1, 1, [10, 11, 5, 5, 5]), (1, 2, [9, 9]), (1, 3, []), (2, 1, [0, 0, 3]), (2, 2, [5, 6, 8])], "doc_id long, para_idx int, counts array<int>")
    out = S.sentence_zoom(x, F.size("counts") >= 3)
    assert {tuple(r) for r in out.collect()} == {(1, 1, "P1.S1-S2"), (1, 1, "P1.S3-S5")} and shuffles(out) == 0  # 0 and 0 differ by no less than a fifth of 0


def test_moving_types_are_counted_in_batches(spark):
    rows = [["A", "a", "b", "a"], [], ["x"], None, list("abcabcabcd")]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, tokens array<string>")
    out = x.select("i", S.moving_types("tokens", 3).alias("m"))
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["i"]: r["m"] for r in out.collect()} == {0: 2 / 3 * 0.5 + 1 / 3, 1: None, 2: 1.0, 3: None, 4: 1.0}


def test_persona_features_cut_a_text_into_sentences_once(spark):
    docs = spark.createDataFrame([(1, "en", "s", "One two. One three, four!\n\n- list\n\nFive."), (2, "en", "s", None)], "doc_id long, lang string, source string, text string")
    out = S.persona_features(docs, ["e "], ["t"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[.!?]+") == 2  # of which a row takes one
    got = {r["doc_id"]: (r["burstiness_cv"], r["mattr"], r["sentence_opener_diversity"], r["comma_per_sentence"], r["lexicon_density_preferred"]) for r in out.collect()}
    assert got == {1: (0.2, 0.9, 0.66667, 0.33333, 285.71429), 2: (0.0, 0.0, 0.0, 0.0, 0.0)}


def test_terms_are_matched_once(spark):
    u = spark.createDataFrame([(1, "en", "The cats and a dog", ["The", "cats", "and", "a", "dog"]), (2, "fr", "le chat", ["le", "chat"]), (3, "en", "", [])], "doc_id long, lang string, text string, tokens array<string>")
    lex = spark.createDataFrame([("en", "strict", "cat"), ("en", "strict", "a dog"), ("en", "phrase", "the ~ and"), ("de", "strict", "chat")], "lang string, kind string, entry string")
    out = R.match_terms(u, lex, ["doc_id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "cat"), (1, "a dog"), (1, "the ~ and")}


def test_lines_and_sentences_without_marks_take_no_pattern_for_them(spark):
    cases = {"a\r\nb\r": ["a", "b\r"], "a\nb": ["a", "b"], "": [""]}
    ends = {"一。二！」三": ["一", "二！」三"], "One. Two!\nx.y": ["One", "Two", "x.y"], "。": []}
    assert {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.split_lines("t").alias("x")).collect()} == cases
    assert {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in ends], "t string").select("t", T.split_sentences("t").alias("x")).collect()} == ends
    lists = {"- a": "", "a:\n1\n2": "a:", "a:": "a:", "3) b\nc": "c"}
    assert {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in lists], "t string").select("t", T.strip_list_blocks("t").alias("x")).collect()} == lists


def test_skip_reasons_need_no_lexicon_and_agree_with_the_scores(spark):
    texts = ["One. Two here.\nThree, four.\n\nFive! Six? Seven", "a b\nc d", "- x\n- y\n- z", "A.\n\nB.\n\nC.", "", None, "One. Two.\r\n \r\nThree。Four\n# Head\nEnd"]
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate([*texts, "a b\nc d"])] + [(1, "e f. g", "en", "web")], "doc_id long, text string, lang string, source string")
    lexicon = spark.createDataFrame([("en", "strict", "one")], "lang string, kind string, entry string")
    for unit in ("line", "paragraph"):
        want = V.document_scores(V.paragraph_rows(docs, lexicon, unit)).select("doc_id", "n_paragraphs", "n_sentences", "skip_reason")
        got = V.skip_reasons(docs, unit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "regexp_extract_all" not in plan


def test_document_frequencies_are_counted_before_the_shuffle(spark):
    """The same counts as by the tokens of document_units(), which went through the shuffle one by one, and to Python's wider \\s and \\w."""
    texts = ["“Ho-la” — _x_ a_b foo_-bar... ΑΣ.Β ΟΔΟΣ’s İs Ho-LA", "一。二！」三 a.b？c\n- list\nx:\n1 a\n2 b", "a b﻿c\u0085d\x1ce f᠎g a", "- item one\n\nEnd! ok.yes", "ab\r\ncd:\n1\n2\n\nef", None, "", "\U0001d400b-\U0001d401 ①② Ⅷ x² ⓐb"]
    docs = spark.createDataFrame([(i, lang, "s", t) for i, t in enumerate(texts) for lang in ("en", "zh", "ko", None)], "doc_id long, lang string, source string, text string")
    want = S.document_units(docs).select("lang", F.explode(F.array_distinct(F.transform("tokens", F.lower))).alias("entry")).groupBy("lang", "entry").agg(F.count("*").alias("n"))
    out = S.document_frequency(docs)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() > 40


def test_counts_that_are_handed_on_early_add_up(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 2)
    docs = spark.createDataFrame([(i, "en", "s", "A b c. d a") for i in range(50)], "doc_id long, lang string, source string, text string")
    assert {(r["entry"], r["n"]) for r in S.document_frequency(docs).collect()} == {(w, 50) for w in "abcd"}


def test_types_are_lower_case_as_spark_has_it(spark):
    rows = [["ΟΔΟΣ", "οδος", "İ", "i̇", "A", "a"], ["ΟΔΟΣ", "οδοσ"]]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, tokens array<string>")
    out = x.select("i", S.moving_types("tokens", 9).alias("m"), F.size(F.array_distinct(F.transform("tokens", F.lower))).alias("n"), F.size("tokens").alias("k"))
    assert "lower(" not in x.select(S.moving_types("tokens", 9))._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["m"] == r["n"] / r["k"] for r in out.collect())


def test_paragraph_marks_are_sought_only_where_their_document_has_them(spark):
    hot = "Here's the thing.\nThe truth is, REAL TALK\nplain real\n* * *\nx\n\n* * *\ny\n\n___\n- - -"
    docs = spark.createDataFrame([(1, "en", "s", hot), (2, "en", "s", "The truth is\n***\nunreal talk"), (3, "en", "s", None)], "doc_id long, lang string, source string, text string")
    lexicon = spark.createDataFrame([("en", "strict", "the truth")], "lang string, kind string, entry string")
    out = V.paragraph_verdicts(docs, lexicon, "line")
    assert "CASE WHEN candour_doc" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["para_idx"]): (r["candour_hot"], r["break_hot"], r["divider"], r["matches"], r["strength"]) for r in out.collect()}
    none = (False, False, False, 0, 0.0)
    breaks = (False, True, True, 0, 33.3333)
    assert got == {
        (1, 1): (True, False, False, 0, 50.0), (1, 2): (True, False, False, 1, 100.0), (1, 3): none, (1, 4): breaks, (1, 5): none, (1, 6): breaks, (1, 7): none, (1, 8): breaks, (1, 9): breaks,
        (2, 1): (False, False, False, 1, 100.0), (2, 2): (False, False, True, 0, 0.0), (2, 3): none,
    }
