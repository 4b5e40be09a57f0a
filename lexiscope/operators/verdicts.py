"""Verdicts and scores of paragraphs, documents and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.functions.text import round_half_up as r6
from lexiscope.operators import korean as K
from lexiscope.operators import rules as R
from lexiscope.operators import style as S

LEAK_FLOOR, MODEL_FLOOR = 90.0, 70.0
#: Upper ends of the score bands, inclusive.
BANDS = ((15, "human"), (30, "mostly-human"), (50, "mixed"), (70, "ai-like"), (100, "ai"))


VERDICT = (
    "doc_id", "para_idx", "lang", "n_sentences", "n_tokens", "cv", "cv_band", "mattr", "mattr_band", "matches", "density", "lexicon_hot", "candour_hot", "break_hot", "diagnostic_hot", "ending_hot", "divider", "hot", "strength",
)


def paragraph_rows(docs: DataFrame, lexicon: DataFrame, unit: str = "paragraph", window: int = 50) -> DataFrame:
    """The rows of paragraph_verdicts(), with source and leaked, and one with a null para_idx for a text without paragraphs.

    Each text is read and cut once; what a document tells of all its paragraphs is worked out before it is cut."""
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(*S.UNIT, "text", R.leaks("text").alias("leak"), (R.candour_count(text) >= R.CANDOUR_MIN).alias("candour_doc"), (R.break_counts(text)["count"] >= R.BREAK_MIN).alias("break_doc"))
    whole = whole.withColumn("leaked", F.size("leak") > 0).drop("leak")
    u = S.units(whole, unit, ("leaked", "candour_doc", "break_doc"), outer=True)
    u = R.matched(u, lexicon, ["doc_id", "para_idx"])
    u = K.signals(S.burstiness(u))
    j = u.select(
        "*", F.size("tokens").alias("n_tokens"), r6(S.moving_types("tokens", window)).alias("mattr"), F.size("entries").cast("long").alias("matches"),
        F.when(F.col("candour_doc"), R.candour_count("text")).otherwise(0).alias("n_candour"), F.when(F.col("break_doc"), R.break_counts("text")["count"]).otherwise(0).alias("n_breaks"), R.divider_only("text").alias("divider"),
    )  # fmt: skip  # both signals need the document's
    density, lexicon_hot = R.density_of(F.col("matches"), F.col("n_tokens"))
    j = j.withColumns({"density": density, "lexicon_hot": lexicon_hot, "mattr_band": S.band(F.col("mattr"), S.MATTR_LOW, S.MATTR_HIGH), "candour_hot": F.col("candour_doc") & (F.col("n_candour") >= 1), "break_hot": F.col("break_doc") & (F.col("n_breaks") >= 1)})
    low = lambda c: F.coalesce(F.col(c) == "low", F.lit(False))
    j = j.withColumn("hot", low("cv_band") | low("mattr_band") | F.col("lexicon_hot") | F.col("candour_hot") | F.col("break_hot") | F.col("diagnostic_hot") | F.col("ending_hot"))
    part = lambda on, v: F.when(on, F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))).otherwise(0.0)
    strength = F.greatest(
        part(low("cv_band"), (1 - F.col("cv") / S.CV_LOW) * 100), part(low("mattr_band"), (1 - F.col("mattr") / S.MATTR_LOW) * 100), part(F.col("lexicon_hot"), (F.col("density") - 3) / 3 * 100),
        F.col("diagnostic_strength"), part(F.col("candour_hot"), F.col("n_candour") * 100.0 / R.CANDOUR_MIN), part(F.col("break_hot"), F.col("n_breaks") * 100.0 / R.BREAK_MIN),
    )
    return j.withColumn("strength", r6(strength, 4)).select("source", "leaked", *VERDICT)


def paragraph_verdicts(docs: DataFrame, lexicon: DataFrame, unit: str = "paragraph", window: int = 50) -> DataFrame:
    """A row per paragraph with all seven signals, whether it is hot, and how deep it lies in its strongest signal."""
    return paragraph_rows(docs, lexicon, unit, window).filter("para_idx is not null").select(*VERDICT)


def interpret(c: Column) -> Column:
    out = F
    for top, name in BANDS:
        out = out.when(c <= top, name)
    return out.otherwise(F.lit(None))


def skip_reason(paragraphs: Column, sentences: Column) -> Column:
    return F.when(paragraphs <= 2, "paragraphs<=2").when(sentences <= 2, "sentences<=2")


def skip_reasons(docs: DataFrame, unit: str = "paragraph") -> DataFrame:
    """doc_id, n_paragraphs, n_sentences, skip_reason as document_scores() has them, from the texts alone: no tokens, lexicon or signals."""
    sentences = F.transform(T.split_paragraphs("text", unit), lambda p: F.size(T.prose_sentences(p)))
    rows = docs.select("doc_id", sentences.alias("n")).select("doc_id", F.size("n").alias("paragraphs"), S.total("n").alias("sentences"))
    g = rows.groupBy("doc_id").agg(F.sum("paragraphs").alias("n_paragraphs"), F.sum("sentences").alias("n_sentences"))
    return g.withColumn("skip_reason", skip_reason(F.col("n_paragraphs"), F.col("n_sentences")))


def document_scores(rows: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """rows of paragraph_rows() -> a row per document: counts, hot, hot ratio, floors, overall score and its band, mean signal strength.

    model(doc_id, model_hot, model_score) is optional; null marks a document without a model."""
    there = F.col("para_idx").isNotNull()
    g = rows.groupBy("doc_id").agg(
        F.first("lang").alias("lang"), F.first("source").alias("source"), F.first("leaked").alias("leaked"), F.count_if(there).alias("n_paragraphs"), F.coalesce(F.sum(F.when(there, F.col("n_sentences"))), F.lit(0)).alias("n_sentences"),
        F.count_if(there & F.col("hot")).alias("n_hot"), F.coalesce(r6(F.avg(F.when(there, F.col("strength"))), 1), F.lit(0.0)).alias("signal_score"),
    )
    if model is None:
        x = g.withColumns({"model_hot": F.lit(None).cast("boolean"), "model_score": F.lit(None).cast("double")})
    else:
        x = g.join(model.select("doc_id", "model_hot", "model_score"), "doc_id", "left")
    ratio = r6(F.coalesce(F.try_divide(F.col("n_hot") * 100.0, "n_paragraphs"), F.lit(0.0)), 1)
    floor = F.greatest(F.when(F.col("leaked"), LEAK_FLOOR).otherwise(0.0), F.when(F.coalesce("model_hot", F.lit(False)), F.greatest(F.lit(MODEL_FLOOR), r6(F.col("model_score") * 100, 1))).otherwise(0.0))
    x = x.withColumns({"hot_ratio": ratio, "evidence_floor": floor, "hot": F.col("leaked") | F.coalesce("model_hot", F.lit(False)) | (F.col("n_hot") > 0), "skip_reason": skip_reason(F.col("n_paragraphs"), F.col("n_sentences"))})
    x = x.withColumn("overall", F.greatest("hot_ratio", "evidence_floor"))
    return x.select("doc_id", "lang", "source", "n_paragraphs", "n_sentences", "n_hot", "hot", "hot_ratio", "evidence_floor", "overall", interpret(F.col("overall")).alias("interpretation"), "signal_score", "skip_reason")


def prose_gate(rows: DataFrame, gate: float = 30.0) -> DataFrame:
    """rows of paragraph_rows() -> doc_id, score over paragraphs that are more than a divider, ranked score over all, floored by leakage, and whether it is over the gate."""
    there = F.col("para_idx").isNotNull()
    prose = there & ~F.col("divider")
    x = rows.groupBy("doc_id").agg(F.first("leaked").alias("leaked"), F.count_if(prose).alias("n_prose"), F.count_if(prose & F.col("hot")).alias("n_hot"), F.count_if(there).alias("n"), F.count_if(there & F.col("hot")).alias("all_hot"))
    pct = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, b), F.lit(0.0))
    ranked = F.greatest(pct("n_hot", "n_prose"), pct("all_hot", "n"))
    return x.select("doc_id", "n_prose", "n_hot", r6(pct("n_hot", "n_prose"), 4).alias("score"), r6(F.when(F.col("leaked"), F.greatest(ranked, F.lit(LEAK_FLOOR))).otherwise(ranked), 4).alias("ranked_score"), (pct("n_hot", "n_prose") > gate).alias("over_gate"))


def short_form_floor(severity: Column, patterns: int = 9, weight: float = 0.18) -> Column:
    return F.least(F.lit(3.0), severity * 1.5) / (patterns * 3) * 100 * weight


def reconcile(df: DataFrame, divergence: float = 20.0) -> DataFrame:
    """df(external, deterministic, floor, skipped) with overall and reason: the floor first, then a skipped text's external score, then the larger where they are apart."""
    e, d, f = F.col("external"), F.col("deterministic"), F.col("floor")
    by_floor = d.isNotNull() & (f > 0) & (e < f)
    apart = d.isNotNull() & ~F.coalesce("skipped", F.lit(False)) & (F.abs(e - d) > divergence)
    by_floor, apart = F.coalesce(by_floor, F.lit(False)), F.coalesce(apart, F.lit(False))
    return df.withColumns({"overall": F.when(by_floor, f).when(apart, F.greatest(e, d)).otherwise(e), "reason": F.when(by_floor, "evidence-floor").when(apart, "divergence")})


FACTORS = {"amplify": 1.5, "reduce": 0.5, "suppress": 0.0}
BOOSTED = ("language", "style", "viral-hook")


def severity_of(instances: Column) -> Column:
    return F.when(instances >= 6, 3).when(instances >= 3, 2).when(instances >= 1, 1).otherwise(0)


def category_scores(hits: DataFrame, patterns: DataFrame, weights: DataFrame, policy: DataFrame) -> DataFrame:
    """Scores per text and category, and their weighted sum.

    hits(doc_id, doc_type, pattern, instances, is_short), patterns(pattern, category), weights(category, weight),
    policy(doc_type, pattern, action). A category without a weight has 0.10."""
    size = patterns.groupBy("category").agg(F.count("*").alias("n_patterns"))
    x = hits.join(patterns, "pattern").join(policy, ["doc_type", "pattern"], "left")
    factor = F.coalesce(*[F.when(F.col("action") == a, f) for a, f in FACTORS.items()], F.lit(1.0))
    boost = F.when(F.col("is_short") & F.col("category").isin(*BOOSTED), 1.5).otherwise(1.0)
    x = x.withColumn("adjusted", F.least(F.lit(3.0), severity_of(F.col("instances")) * factor * boost))
    c = x.groupBy("doc_id", "category").agg(F.sum("adjusted").alias("s")).join(size, "category").join(weights, "category", "left")
    c = c.select("doc_id", "category", (F.col("s") / (F.col("n_patterns") * 3) * 100).alias("score"), F.coalesce("weight", F.lit(0.10)).alias("weight"))
    return c.groupBy("doc_id").agg(F.count("*").alias("categories"), r6(F.max("score"), 4).alias("top_score"), r6(F.sum(F.col("score") * F.col("weight")), 4).alias("overall"))


def apply_policy(patterns: DataFrame, policy: DataFrame) -> DataFrame:
    """Patterns of each document type that its policy doesn't suppress."""
    return patterns.join(policy.filter("action = 'suppress'"), ["doc_type", "pattern"], "left_anti")


def combined(df: DataFrame, weights: DataFrame, third: float = 0.0) -> DataFrame:
    """df(doc_type, ai, fidelity, deterministic) with combined: the weighted sum of ai and 100 - fidelity, and of the deterministic score if it has a weight."""
    x = df.join(weights, "doc_type", "left")
    wa, wf = F.coalesce("w_ai", F.lit(0.6)), F.coalesce("w_fidelity", F.lit(0.4))
    two = F.col("ai") * wa + (100 - F.col("fidelity")) * wf
    three = F.when(F.lit(third > 0) & F.col("deterministic").isNotNull(), (two + F.col("deterministic") * third) / (wa + wf + third))
    return x.withColumn("combined", r6(F.coalesce(three, two), 1)).drop("w_ai", "w_fidelity")


def mps(anchors: DataFrame, key: str) -> DataFrame:
    """anchors(key, polar, passed) -> key, anchors, mps: 0.6 pass rate + 0.4 polarity rate; the pass rate alone without polar anchors."""
    g = anchors.groupBy(key).agg(F.count("*").alias("anchors"), F.count_if("passed").alias("ok"), F.count_if("polar").alias("polar"), F.count_if(F.col("polar") & F.col("passed")).alias("polar_ok"))
    rate = F.col("ok") / F.col("anchors")
    return g.select(key, "anchors", r6(100 * F.when(F.col("polar") > 0, 0.6 * rate + 0.4 * F.try_divide("polar_ok", "polar")).otherwise(rate), 4).alias("mps"))


def clamp03(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.floor(F.coalesce(c.cast("double"), F.lit(0.0)) + 0.5).cast("double")))


def length_points(original: Column, rewrite: Column) -> Column:
    pct = F.try_divide(F.char_length(rewrite) * 100.0, F.char_length(original))
    return F.when(pct.isNull() | pct.between(50, 130), 3).when((pct >= 35) & (pct <= 150), 2).when((pct >= 25) & (pct <= 200), 1).otherwise(0)


def fidelity(df: DataFrame) -> DataFrame:
    """df(claims, fabrication, register, original, rewrite) with length_points and fidelity (0 to 100)."""
    p = length_points(F.col("original"), F.col("rewrite"))
    total = clamp03(F.col("claims")) + clamp03(F.col("fabrication")) + clamp03(F.col("register")) + p
    return df.withColumns({"length_points": p, "fidelity": r6(total / 12 * 100, 1)})


def floors(df: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """Adds failed (names under their floor, comma-joined) and passed; a null value fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c) >= b, F.lit(False)), c) for c, b in bounds.items()]))
    return df.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.col("failed") == "")


def audit_rows(docs: DataFrame, paras: DataFrame) -> DataFrame:
    """doc_id, signal, severity, n, samples: one row for each signal that fired in a document."""
    signals = {"burstiness": F.col("cv_band") == "low", "mattr": F.col("mattr_band") == "low", "lexicon": F.col("lexicon_hot"), "candour": F.col("candour_hot"), "breaks": F.col("break_hot"), "diagnostics": F.col("diagnostic_hot"), "endings": F.col("ending_hot")}
    cells = F.array(*[F.struct(F.lit(n).alias("signal"), F.coalesce(c, F.lit(False)).alias("on")) for n, c in signals.items()])
    rows = paras.select("doc_id", "para_idx", F.inline(cells)).filter("on").groupBy("doc_id", "signal").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("para_idx")), 1, 4), ",").alias("samples"))
    leaks = R.markup_leakage(docs).filter("leaked").select("doc_id", F.lit("leakage").alias("signal"), F.col("n_hits").cast("long").alias("n"), F.array_join(F.slice("samples", 1, 4), ",").alias("samples"))
    return rows.unionByName(leaks).withColumn("severity", F.when(F.col("signal") == "leakage", 3).otherwise(severity_of(F.col("n"))))


def panel_verdict(df: DataFrame, threshold: float = 35.0, least: float = 0.85) -> DataFrame:
    """df(score, expected) -> one row: accuracy, rates, and whether a fresh corpus passes."""
    hot = F.col("score") >= threshold
    g = df.agg(F.count("*").alias("n"), r6(F.avg((hot == F.col("expected")).cast("double")), 5).alias("accuracy"), r6(F.try_divide(F.count_if(hot & F.col("expected")), F.count_if("expected")), 5).alias("tpr"), r6(F.try_divide(F.count_if(hot & ~F.col("expected")), F.count_if(~F.col("expected"))), 5).alias("fpr"))
    return g.withColumn("passes", F.coalesce(F.col("accuracy") >= least, F.lit(False)))


def audit_weights(emitted: DataFrame, config: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """category, emitted, configured, status: ok, mismatch, missing or unexpected."""
    j = emitted.join(config, "category", "full")
    status = F.when(F.col("emitted").isNull(), "missing").when(F.col("configured").isNull(), "unexpected").when(F.abs(F.col("emitted") - F.col("configured")) > tolerance, "mismatch").otherwise("ok")
    return j.select("category", r6(F.col("emitted")).alias("emitted"), r6(F.col("configured")).alias("configured"), status.alias("status"))


#: Upper ends of the badge's bands, inclusive, their texts and colours.
BADGES = ((30, "human-ish", "brightgreen"), (50, "mixed", "yellow"), (None, "ai-like", "red"))


def corpus_status(scores: DataFrame, gate: float = 30.0) -> DataFrame:
    """One row: files, failed ones, the highest score, and the badge's text and colour."""
    g = scores.agg(F.count("*").alias("files"), F.count_if(F.col("score") > gate).alias("failed"), F.max("score").alias("max_score"))
    top = F.coalesce("max_score", F.lit(0.0))
    pick = lambda n: F.when(top <= BADGES[0][0], BADGES[0][n]).when(top <= BADGES[1][0], BADGES[1][n]).otherwise(BADGES[2][n])
    return g.withColumns({"message": F.concat(F.floor(top + 0.5).cast("string"), F.lit("% · "), pick(1)), "badge": pick(2)})


def already_clean(scores: DataFrame, paragraphs: int = 3, signal: float = 10.0) -> DataFrame:
    return scores.filter((F.col("n_paragraphs") >= paragraphs) & (F.col("n_hot") == 0) & (F.col("signal_score") <= signal))

