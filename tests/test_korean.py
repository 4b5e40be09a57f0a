"""Korean measures, by hand; the driver's tables hold no Korean."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiscope.operators import korean as K
from lexiscope.operators import style as S


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "ko", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("text, want", [("잘 됩니다", "ㅂ니다"), ("그것은 아니다", "다"), ("밥을 했다.", "했다"), ("좋습니다", "습니다"), ("hello", None), ("갔어요", "어요"), ("합니까", "합니까")])
def test_endings(spark, text, want):
    assert docs(spark, text).select(K.sentence_ending("text").alias("e")).first()["e"] == want


def test_words_and_spacing(spark):
    d = docs(spark, "나는 학교에 (갔다) abc 가")
    assert d.select(K.eojeols("text").alias("w")).first()["w"] == ["나는", "학교에", "갔다", "가"]
    r = K.spacing_profile(d).first()
    assert (r["eojeols"], r["mean_length"], r["single_share"], r["long_share"]) == (4, 2.0, 0.25, 0.0)


def test_suffixes(spark):
    r = K.suffix_profile(docs(spark, "나는 학교에서 책을 친구에게서 은")).first()
    assert (r["suffixes"], r["class_diversity"]) == (4, 1.0)


def test_monotony_and_register(spark):
    plain = " ".join(["이것은 아주 짧은 문장 하나이다."] * 5)
    r = K.ending_monotony(S.document_units(docs(spark, plain))).first()
    assert (r["plain_count"], r["plain_share"], r["ending_hot"]) == (5, 1.0, True)
    regs = {r["doc_id"]: (r["classified"], r["register"]) for r in K.register(S.document_units(docs(spark, plain, "갑니다. 옵니다. 먹어요.", "갑니다. 먹어요. 한다.", "간다. 온다."))).collect()}
    assert regs == {0: (5, "plain"), 1: (3, "formal"), 2: (3, "mixed"), 3: (2, None)}


def test_diagnostics(spark):
    even = " ".join(["사람들은 학교에서 책들을 읽었고 음악을 들었다."] * 6)
    r = K.diagnostics(S.document_units(docs(spark, even))).first()
    assert r["diagnostic_hot"] and 0 < r["diagnostic_strength"] <= 100
    assert not K.diagnostics(S.document_units(docs(spark, "짧은 글이다."))).first()["diagnostic_hot"]


def test_independent_hits(spark):
    rows = [(1, "a", True, 0, 5, "x"), (1, "b", False, 3, 9, "x"), (1, "c", False, 9, 12, "x")]
    hits = spark.createDataFrame(rows, "doc_id long, rule string, strong boolean, start int, end int, text string")
    assert sorted((r["start"], r["end"]) for r in K.independent_hits(hits).collect()) == [(0, 5), (9, 12)]


def test_calques(spark):
    text = "당신은 그녀가 작업이 에이전트에 의해 처리되었다고 했다. 회의에서의 결정은 되어진다. 로그는 그대로다."
    d = docs(spark, text, "평범한 글이다.")
    rules = {r["rule"] for r in K.apply_rules(d).collect()}
    assert {"direct-address-you", "a16-pronoun-literal", "t2-by-passive", "passive-e-uihae", "a19-double-particle", "a8-double-passive"} <= rules
    got = {r["doc_id"]: (r["hot"], r["count"] > 0) for r in K.translationese(S.document_units(d), d).collect()}
    assert got == {0: (True, True), 1: (False, False)}


def test_post_edit_profile(spark):
    d = docs(spark, "나는 간다. 너는 온다, 그리고 쉰다. 그녀는 읽고 있다.", "no Hangul here")
    r = K.post_edit_profile(S.document_units(d), ["doc_id"]).collect()
    assert len(r) == 1 and r[0]["endings"]["plain"] == 3 and r[0]["endings"]["plain_streak"] == 3
    assert r[0]["interference"]["pronouns"] == 1 and r[0]["interference"]["progressives"] == 1 and r[0]["lexical"]["tokens"] == 9 and r[0]["rhythm"]["commas_per_sentence"] == pytest.approx(0.333333)


def test_korean_queries_need_no_korean(spark):
    d = docs(spark, "x").withColumn("lang", F.lit("en"))
    assert K.apply_rules(d).count() == 0 and K.post_edit_profile(S.document_units(d), ["doc_id"]).count() == 0
