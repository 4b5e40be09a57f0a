"""Queries of detector evaluation and study statistics over labelled documents and the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators import evaluation as E
from lexiscope.operators import stats as X
from lexiscope.plans import sql as Q
from lexiscope.session import table

R = Q.r6
SIGNALS = ["sig_repeat", "sig_short", "sig_marks"]


def measured(text):
    words = T.non_empty(F.split(F.lower(text), r"[ \t\n\r\f]+", -1))
    return words


def repeated(w):
    """The percentage of repeated words to one digit, halves up; the product comes before the quotient, so a half is exact."""
    return F.coalesce(F.floor(F.try_divide(1000.0 * (F.size(w) - F.size(F.array_distinct(w))), F.size(w)) + 0.5) / 10, F.lit(0.0))


def scored(spark, d):
    """Labelled documents: expected = low quality; the score is the percentage of repeated words."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    x = docs.join(labels, "doc_id").select("doc_id", "lang", "source", "text", "n_chars", (F.col("quality") == 0).alias("expected"), measured("text").alias("w"))
    x = x.select("*", F.size("w").alias("n_words"), repeated("w").alias("score"))
    return x.select(
        "doc_id", "lang", "source", "text", "n_chars", "expected", "score", "n_words", (F.col("score") >= 60).alias("predicted"), F.concat(F.lit("f"), F.pmod("doc_id", F.lit(4)).cast("string")).alias("family"),
        (F.col("score") >= 75).alias("sig_repeat"), (F.col("n_words") < 60).alias("sig_short"), (F.regexp_count("text", F.lit("[|*]")) >= 5).alias("sig_marks"),
    )


WORDS = r"list_filter(string_split_regex(lower({}), '[ \t\n\r\f]+'), lambda x: x <> '')"
SCORED = rf"""w as (select d.doc_id, lang, source, text, n_chars, quality = 0 as expected, {WORDS.format('text')} as w from documents d join labels using (doc_id)),
s0 as (select *, len(w) as n_words, coalesce(floor(1000 * (len(w) - len(list_distinct(w)))::double / nullif(len(w), 0) + 0.5) / 10, 0) as score from w),
s as (select doc_id, lang, source, text, n_chars, expected, score, n_words, score >= 60 as predicted, 'f' || (doc_id % 4) as family, score >= 75 as sig_repeat, n_words < 60 as sig_short, len(regexp_extract_all(text, '[|*]')) >= 5 as sig_marks from s0)"""
CELLS = "count(*) filter (where expected and predicted) as tp, count(*) filter (where not expected and predicted) as fp, count(*) filter (where expected and not predicted) as fn, count(*) filter (where not expected and not predicted) as tn"


def rates(source):
    d = lambda a, b: R(f"({a})::double / nullif({b}, 0)")
    return f"select *, tp + fp + fn + tn as n, {d('tp + tn', 'tp + fp + fn + tn')} as accuracy, {d('tp', 'tp + fp')} as precision, {d('tp', 'tp + fn')} as recall, {d('2 * tp', '2 * tp + fp + fn')} as f1, {d('fp', 'fp + tn')} as fpr, {d('fn', 'fn + tp')} as fnr from {source}"


def wilson(k, n):
    z = E.Z
    p = f"({k}::double / {n})"
    low = f"greatest(0, ({p} + {z * z} / (2.0 * {n}) - {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n}))"
    high = f"least(1, ({p} + {z * z} / (2.0 * {n}) + {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n}))"
    return f"case when {n} > 0 then {R(low)} end", f"case when {n} > 0 then {R(high)} end"


def sweep_sql(keys=""):
    k = f"{keys}, " if keys else ""
    ends = f"select distinct {k}unnest([0.0, 101.0]) as score from s" if keys else "select unnest([0.0, 101.0]) as score"
    part = f"partition by {keys}" if keys else ""
    return f"""b as (select {k}score, count(*) filter (where expected) as pos, count(*) filter (where not expected) as neg from s group by {k}score),
e as (select {k}score, sum(pos) as pos, sum(neg) as neg from (select * from b union all select *, 0, 0 from ({ends})) group by {k}score),
c as (select {k}score as threshold, sum(pos) over ({part} order by score desc) as tp, sum(neg) over ({part} order by score desc) as fp, sum(pos) over ({part}) as p, sum(neg) over ({part}) as q from e),
sw as ({rates(f"(select {k}threshold, tp, fp, p - tp as fn, q - fp as tn from c)")})"""


def modes(spark, d):
    x = scored(spark, d)
    return x.withColumns({f"m{t}": F.col("score") >= t for t in (40, 60, 80)})


def robust(spark, d):
    x = scored(spark, d)
    forms = F.array(*[F.struct(F.lit(n).alias("transform"), f("text").alias("t2")) for n, f in T.TRANSFORMS.items()])
    x = x.select("doc_id", "lang", "expected", F.col("predicted").alias("before"), F.inline(forms))
    w = measured("t2")
    x = x.select("*", w.alias("w")).withColumn("after", repeated("w") >= 60)
    return E.robustness(x)


def baseline(spark, d):
    x = scored(spark, d)
    expected = table(spark, d, "documents").groupBy("lang").agg((F.count("*") * 0.4).cast("long").alias("expected_n"))
    return E.corpus_baseline(x, expected, SIGNALS, "lang")


def detectors(spark, d):
    x = scored(spark, d)
    labels = table(spark, d, "documents").select("doc_id", F.inline(F.array(*[F.struct(F.lit(f"outside{m}").alias("detector"), (F.pmod("n_chars", F.lit(m)) == 0).alias("predicted")) for m in (2, 3)]))).filter("doc_id % 5 <> 0")
    return E.detector_comparison(x, labels)


def judged(spark, d):
    """Order lines as ratings: the order is the item, the line number the judge, the discount the score."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("judge"), (F.col("l_discount") * 100).cast("long").alias("value"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")


def charges(spark, d):
    amounts = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("amount"))
    prices = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.max("l_linenumber").cast("long").alias("price"))
    return E.usage_charges(amounts, prices, 7)


def usage(spark, d):
    ev = table(spark, d, "events").select("event_type", F.when(F.col("event_type") == "click", F.col("event_id")).alias("input_tokens"), F.when(F.col("event_type") == "view", F.col("user_id")).alias("prompt_tokens"), F.when(F.col("event_type") == "error", F.col("user_id")).alias("output_tokens"))
    return E.usage_totals(ev, ["event_type"], {"input": ["input_tokens", "prompt_tokens"], "output": ["output_tokens"]})


def pairs_of(spark, d):
    x = judged(spark, d)
    side = lambda n: X.panel_score(x.filter(f"judge % 2 = {n}"), "item", "judge", "value", 1)
    a = side(0).select("item", F.col("score").alias("before"), F.col("judges").alias("before_judges"))
    b = side(1).select("item", F.col("score").alias("after"), F.col("judges").alias("after_judges"))
    return a.join(b, "item")


def paired(spark, d):
    return X.paired_study(pairs_of(spark, d).withColumn("class", F.when(F.col("item") % 2 == 0, "ai").otherwise("human")))


def calibrated(spark, d):
    x = judged(spark, d)
    score = (F.col("value") * 10).cast("double")
    x = x.select(F.col("l_returnflag").alias("judge"), F.when(F.col("l_returnflag") == "A", "f1").otherwise("f2").alias("judge_family"), "item", F.col("judge").alias("line"), score.alias("score"), (score >= 50).alias("called"), (F.col("l_linestatus") == "O").alias("expected"), F.concat(F.lit("f"), F.pmod("item", F.lit(3))).alias("family"))
    # an item's lines are its repeats; the keys of the bootstrap are items
    return X.judge_calibration(x.withColumn("repeat", F.when(F.col("line") % 2 == 1, 0).otherwise(1)).withColumn("item", F.floor(F.col("item") / 10)), iterations=40)


CUES = [("license", r"licen[sc]e"), ("mail", r"@"), ("table", r"\|"), ("shout", r"!!")]

QUERIES = {
    "e1_confusion": lambda s, d: E.confusion(scored(s, d)),
    "e2_wilson": lambda s, d: E.with_interval(scored(s, d).groupBy("lang").agg(F.count_if(F.col("predicted") == F.col("expected")).alias("k"), F.count("*").alias("n")), "k", "n", "accuracy"),
    "e3_confusion_by_register": lambda s, d: E.confusion(scored(s, d), ["source"]),
    "e4_slices": lambda s, d: E.slices(scored(s, d), ["lang", "source", "family"]),
    "e5_resolve_slices": lambda s, d: E.resolve(scored(s, d).withColumns({"register": F.when(F.col("doc_id") % 3 == 0, F.lit(" ")), "alias": F.when(F.col("doc_id") % 2 == 0, F.col("source"))}), "register", ["alias"], F.when(F.col("expected"), "synthetic").otherwise("human")).groupBy("register").agg(F.count("*").alias("n")),
    "e6_detector_metrics": lambda s, d: E.detector_metrics(scored(s, d), SIGNALS),
    "e7_catch_rates": lambda s, d: E.catch_rates(scored(s, d), "family"),
    "e8_count_by": lambda s, d: scored(s, d).cube("lang", "family").agg(F.count("*").alias("n"), F.count_if("expected").alias("pos")),
    "e9_claim_gate": lambda s, d: E.claim_gate(scored(s, d), "family", least=20),
    "e10_threshold_sweep": lambda s, d: E.threshold_sweep(scored(s, d), ["lang"]),
    "e11_best_f1": lambda s, d: E.best_f1(E.threshold_sweep(scored(s, d), ["lang"]), ["lang"]),
    "e12_roc_auc": lambda s, d: E.roc_auc(scored(s, d), ["lang"]),
    "e13_average_precision": lambda s, d: E.average_precision(scored(s, d), ["lang"]),
    "e14_tpr_at_fpr": lambda s, d: E.tpr_at_fpr(scored(s, d), [0.01, 0.05], ["lang"]),
    "e15_low_fpr_report": lambda s, d: E.low_fpr_report(scored(s, d), [0.01, 0.05], "family"),
    "e16_ranking_summary": lambda s, d: E.ranking_summary(scored(s, d)),
    "e17_ablation": lambda s, d: E.ablation(scored(s, d), SIGNALS),
    "e18_candidate_eval": lambda s, d: E.candidate_eval(scored(s, d), SIGNALS, F.col("lang") == "en"),
    "e19_robustness": robust,
    "e20_mode_comparison": lambda s, d: E.mode_comparison(modes(s, d), ["m40", "m60", "m80"]),
    "e21_corpus_baseline": baseline,
    "e22_check_ranges": lambda s, d: E.check_ranges(scored(s, d), E.make_ranges(scored(s, d).filter("doc_id % 2 = 0"), "score", "lang", 0.5), "score", "lang"),
    "e23_detector_comparison": detectors,
    "e24_latency_summary": lambda s, d: E.latency_summary(table(s, d, "events"), "value", ["event_type"]),
    "e25_usage_totals": usage,
    "e26_usage_charges": charges,
    "x1_bootstrap_ci": lambda s, d: X.bootstrap_ci(scored(s, d), "score", 100, 7, ["lang"], "doc_id"),
    "x2_krippendorff": lambda s, d: X.krippendorff(judged(s, d), "item", "value"),
    "x3_spearman": lambda s, d: X.spearman(scored(s, d), "score", "n_chars", ["lang"]),
    "x4_cliffs_delta": lambda s, d: X.cliffs_delta(scored(s, d), ["lang"]),
    "x5_cohesion": lambda s, d: X.cohesion(table(s, d, "embeddings"), "embedding", ["label"]),
    "x5_cohesion_test": lambda s, d: X.cohesion_test(table(s, d, "embeddings"), "embedding", F.col("label") == 0, "vec_id", 20),
    "x6_panel_score": lambda s, d: X.panel_score(judged(s, d), "item", "judge", "value"),
    "x7_efficacy": lambda s, d: X.efficacy(pairs_of(s, d).withColumn("block", F.pmod("item", F.lit(3))), ["block"]),
    "x8_agreement": lambda s, d: X.agreement(pairs_of(s, d), "item", "before", "after"),
    "x9_paired_study": paired,
    "x9_paired_delta": lambda s, d: paired(s, d).select("class", "pairs", "lost", "delta"),
    "x10_classify_cues": lambda s, d: X.classify_cues(table(s, d, "documents"), "text", CUES),
    "x11_judge_calibration": calibrated,
    "x11_judge_measures": lambda s, d: calibrated(s, d).drop("auc_low", "auc_high"),
    "x12_merge_repeats": lambda s, d: X.merge_repeats(judged(s, d), "item", "value", "l_returnflag", ["N", "R", "A"]),
}


def stacked(pairs, extra=""):
    return " union all ".join(f"select {extra}expected, '{n}' as k, {c} as predicted from s" for n, c in pairs)


J = "j as (select l_orderkey as item, l_linenumber as judge, cast(round(l_discount * 100) as bigint) as value, l_returnflag, l_linestatus from lineitem)"
PANEL = lambda where, q: f"select item, count(*) as judges, case when count(*) >= {q} then {R('avg(v)', 4)} end as score from (select item, judge, avg(value) as v from j where value is not null and {where} group by all) group by item"
PAIRS = f"{J}, pb as ({PANEL('judge % 2 = 0', 1)}), pa as ({PANEL('judge % 2 = 1', 1)}), pr as (select item, pb.score as before, pb.judges as before_judges, pa.score as after, pa.judges as after_judges from pb join pa using (item))"
KRIPP = lambda src: f"""ku as (select item, count(*) as m, sum(value) as s, sum(value * value) as q from {src} where value is not null group by item having count(*) >= 2),
ka as (select count(*) as units, sum(m) as ratings, sum(2.0 * (m * q - s * s) / (m - 1)) as d, sum(s) as s, sum(q) as q from ku),
kk as (select units, ratings::bigint as ratings, case when units >= 2 and ratings * q - s * s <> 0 then {R('1 - (d / ratings) / (2.0 * (ratings * q - s * s) / (ratings * (ratings - 1.0)))', 5)} end as alpha from ka)"""  # noqa: E731
MID = lambda c, by: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0"
AUC = lambda k, src="s": f"""g as (select {k}, score, count(*) filter (where expected) as pos, count(*) filter (where not expected) as neg from {src} group by all),
h as (select *, coalesce(sum(neg) over (partition by {k} order by score rows between unbounded preceding and 1 preceding), 0) as under from g),
a as (select {k}, sum(pos)::bigint as pos, sum(neg)::bigint as neg, {R('sum(pos * (2 * under + neg))::double / nullif(2.0 * sum(pos) * sum(neg), 0)')} as auc from h group by {k})"""  # noqa: E731
LOW, HIGH = wilson("k", "n")
DOCS2 = "select doc_id, 'outside{m}' as detector, n_chars % {m} = 0 as predicted from documents where doc_id % 5 <> 0"
FORMS = {
    "zero_width": r"regexp_replace(text, '((?:[^\s]\s*){3}[^\s])', '\1' || chr(8203), 'g')", "homoglyph": f"translate(text, '{T.HOMOGLYPHS[0]}', '{T.HOMOGLYPHS[1]}')", "upper": "upper(replace(text, 'ß', 'ss'))",
    "strip_punct": r"regexp_replace(text, '[.,!?;:()\[\]{}" + '"' + r"''…—–\-。！？、]', '', 'g')",
    "repeat": r"array_to_string(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+$'), lambda p: case when regexp_matches(p, '[^.!?\s]') then p || p else p end), '')",
}
DELTA = "".join(f", {R(f'm{b}_{x} - m{a}_{x}')} as m{b}_{x}_delta" for a, b in ((40, 60), (60, 80)) for x in ("recall", "fpr"))

ORACLES = {
    "e1_confusion": f"with {SCORED}, c as (select {CELLS} from s) {rates('c')}",
    "e2_wilson": f"with {SCORED}, c as (select lang, count(*) filter (where predicted = expected) as k, count(*) as n from s group by lang) select *, {LOW} as accuracy_low, {HIGH} as accuracy_high from c",
    "e3_confusion_by_register": f"with {SCORED}, c as (select source, {CELLS} from s group by source) {rates('c')}",
    "e4_slices": f"with {SCORED}, x as (select expected, predicted, unnest([{{'dim': 'lang', 'value': lang}}, {{'dim': 'source', 'value': source}}, {{'dim': 'family', 'value': family}}], recursive := true) from s), c as (select dim, coalesce(nullif(trim(value), ''), 'unspecified') as value, {CELLS} from x group by all), m as ({rates('c')}) select *, case when n < 5 then 'insufficient-data' else 'ok' end as status from m",
    "e5_resolve_slices": f"with {SCORED} select coalesce(case when doc_id % 2 = 0 then source end, case when expected then 'synthetic' else 'human' end) as register, count(*) as n from s group by 1",
    "e6_detector_metrics": f"with {SCORED}, x as ({stacked([(c, c) for c in SIGNALS])}), c as (select k as detector, {CELLS} from x group by k) {rates('c')}",
    "e7_catch_rates": f"with {SCORED}, c as (select lang, family, 'catch' as kind, count(*) filter (where predicted) as k, count(*) as n from s where expected group by all union all select lang, null, 'false_positive', count(*) filter (where predicted), count(*) from s where not expected group by lang) select *, {R('k::double / n')} as rate, {LOW} as rate_low, {HIGH} as rate_high from c",
    "e8_count_by": f"with {SCORED} select lang, family, count(*) as n, count(*) filter (where expected) as pos from s group by cube (lang, family)",
    "e9_claim_gate": f"with {SCORED}, c as (select lang, family, count(*) as n, count(*) filter (where predicted is null) as open from s group by all), g as (select count(*) filter (where n >= 20) as cells, count(distinct case when n >= 20 then lang end) as langs, count(distinct case when n >= 20 then family end) as families, sum(open)::bigint as open from c), b as (select *, array_to_string(list_filter([case when langs < 2 then 'languages' end, case when families < 3 then 'families' end, case when open > 0 then 'outcomes' end], lambda x: x is not null), ',') as blockers from g) select *, blockers = '' as ok from b",
    "e10_threshold_sweep": f"with {SCORED}, {sweep_sql('lang')} select * from sw",
    "e11_best_f1": f"with {SCORED}, {sweep_sql('lang')} select * from sw qualify row_number() over (partition by lang order by f1 desc nulls last, precision desc nulls last, recall desc nulls last, fpr asc nulls last, threshold desc) = 1",
    "e12_roc_auc": f"with {SCORED}, {AUC('lang')} select * from a",
    "e13_average_precision": f"with {SCORED}, g as (select lang, score, count(*) filter (where expected) as pos, count(*) as n from s group by all), h as (select *, sum(pos) over w as tp, sum(n) over w as cnt from g window w as (partition by lang order by score desc)) select lang, {R('sum(pos * tp::double / cnt) / nullif(sum(pos), 0)')} as ap from h group by lang",
    "e14_tpr_at_fpr": f"with {SCORED}, {sweep_sql('lang')}, t as (select *, unnest([0.01, 0.05]) as target from sw), bd as (select *, floor(target * (fp + tn) + 1e-9)::bigint as budget from t) select lang, target, budget, threshold, recall as tpr, fpr from bd where fp <= budget qualify row_number() over (partition by lang, target order by tp desc, fp, threshold desc) = 1",
    "e15_low_fpr_report": f"with {SCORED.replace('s as (', 's9 as (')}, s as (select score, expected, 'lang' as level, lang as cell from s9 union all select score, expected, 'lang_register', lang || '/' || family from s9), {sweep_sql('level, cell')}, t as (select *, unnest([0.01, 0.05]) as target from sw), bd as (select *, floor(target * (fp + tn) + 1e-9)::bigint as budget from t), o as (select level, cell, target, budget, threshold, recall as tpr, fpr from bd where fp <= budget qualify row_number() over (partition by level, cell, target order by tp desc, fp, threshold desc) = 1), z as (select level, cell, count(*) filter (where expected) as pos, count(*) filter (where not expected) as neg from s group by all) select o.*, pos, neg, case when pos = 0 or neg = 0 then 'one-class' when pos + neg < 20 then 'thin' else 'ok' end as status from o join z using (level, cell)",
    "e16_ranking_summary": f"with {SCORED}, {sweep_sql()}, x as (select *, 1 as one from s), {AUC('one', 'x')}, h2 as (select score, count(*) filter (where expected) as pos, count(*) as n from s group by score), h3 as (select *, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as cnt from h2), bf as (select threshold as best_threshold, f1 as best_f1 from sw order by f1 desc nulls last, precision desc nulls last, recall desc nulls last, fpr asc nulls last, threshold desc limit 1) select (select min(score) from s) as min_score, (select max(score) from s) as max_score, (select count(*) from s) as n, a.pos, a.neg, a.auc, (select {R('sum(pos * tp::double / cnt) / nullif(sum(pos), 0)')} from h3) as ap, best_threshold, best_f1 from a, bf",
    "e17_ablation": f"with {SCORED}, x as (" + " union all ".join(f"select expected, sig_repeat or sig_short or sig_marks as f, {' or '.join(o for o in SIGNALS if o != c)} as r, '{c}' as signal from s" for c in SIGNALS) + f"), g as (select signal, count(*) filter (where f and not r and expected) as only_tp, count(*) filter (where f and not r and not expected) as only_fp, count(*) filter (where f and expected)::double as ftp, count(*) filter (where f and not expected) as ffp, count(*) filter (where not f and expected) as ffn, count(*) filter (where r and expected)::double as rtp, count(*) filter (where r and not expected) as rfp, count(*) filter (where not r and expected) as rfn from x group by signal) select signal, only_tp, only_fp, {R('rtp / nullif(rtp + rfp, 0) - ftp / nullif(ftp + ffp, 0)')} as precision_delta, {R('rtp / nullif(rtp + rfn, 0) - ftp / nullif(ftp + ffn, 0)')} as recall_delta from g",
    "e18_candidate_eval": f"with {SCORED}, x as (" + " union all ".join(f"select expected, predicted, lang = 'en' as guarded, '{c}' as candidate, {c} as fired from s" for c in SIGNALS) + "), g as (select candidate, count(*) filter (where fired) as fires, count(*) filter (where fired and not predicted and expected) as add_tp, count(*) filter (where fired and not predicted and not expected) as add_fp, count(*) filter (where fired and not predicted and not expected and guarded) as guarded_fp from x group by candidate) select *, case when add_tp > add_fp and guarded_fp = 0 then 'PROMOTE' else 'HOLD' end as decision from g",
    "e19_robustness": f"with {SCORED}, x as (" + " union all ".join(f"select doc_id, lang, expected, predicted as before, '{n}' as transform, {f} as t2 from s" for n, f in FORMS.items()) + f"), y as (select *, {WORDS.format('t2')} as v from x), z as (select *, coalesce(floor(1000 * (len(v) - len(list_distinct(v)))::double / nullif(len(v), 0) + 0.5) / 10, 0) >= 60 as after from y), g as (select transform, lang, count(*) filter (where before and expected) as caught, count(*) filter (where before and after and expected) as still_caught, count(*) filter (where not before and not expected) as clean, count(*) filter (where not before and not after and not expected) as still_clean, count(*) filter (where before <> after) as changed from z group by all) select *, {R('still_caught::double / nullif(caught, 0)')} as detection_kept, {R('still_clean::double / nullif(clean, 0)')} as clean_kept from g",
    "e20_mode_comparison": f"with {SCORED}, x as ({stacked([(f'm{t}', f'score >= {t}') for t in (40, 60, 80)])}), c as (select k, {CELLS} from x group by k), m as ({rates('c')}), wd as (select " + ", ".join(f"max({x}) filter (where k = 'm{t}') as m{t}_{x}" for t in (40, 60, 80) for x in ("recall", "fpr")) + f" from m) select *{DELTA} from wd",
    "e21_corpus_baseline": f"with {SCORED}, g as (select lang, count(*) as n, {', '.join(f'count(*) filter (where {c}) as fires_{c}' for c in SIGNALS)} from s group by lang), e as (select lang, floor(count(*) * 0.4)::bigint as expected_n from documents group by lang) select lang, n, {', '.join(f'fires_{c}' for c in SIGNALS)}, expected_n, coalesce(n, 0) - coalesce(expected_n, 0) as drift from g full join e using (lang)",
    "e22_check_ranges": f"with {SCORED}, r as (select lang, {R('min(score) - 0.5')} as low, {R('max(score) + 0.5')} as high from s where doc_id % 2 = 0 group by lang) select lang, count(*) as n, count(*) filter (where coalesce(score < low or score > high, true)) as outside from s left join r using (lang) group by lang",
    "e23_detector_comparison": f"with {SCORED}, l as ({DOCS2.format(m=2)} union all {DOCS2.format(m=3)}), k as (select l.*, s.expected from l left join s using (doc_id)), c as (select detector, {CELLS} from k where expected is not null group by detector), m as ({rates('c')}), u as (select detector, count(*) filter (where expected is null) as unknown from k group by detector) select m.*, unknown, (select count(*) from s) as total, {R('n::double / (select count(*) from s)')} as coverage from m join u using (detector)",
    "e24_latency_summary": f"select event_type, count(value) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, {R('avg(value)', 4)} as mean, {R('1000 / nullif(avg(value), 0)', 4)} as per_second from events group by event_type",
    "e25_usage_totals": "select event_type, count(*) as calls, sum(case event_type when 'click' then event_id when 'view' then user_id end)::bigint as input, sum(case when event_type = 'error' then user_id end)::bigint as output from events group by event_type",
    "e26_usage_charges": "with p as (select l_returnflag as kind, max(l_linenumber) as price from lineitem group by 1) select l_suppkey as account, count(*) as lines, sum(ceil(cast(floor(l_quantity) as bigint) / 7.0))::bigint as grains, sum(ceil(cast(floor(l_quantity) as bigint) / 7.0) * price)::bigint as charge from lineitem join p on l_returnflag = kind group by 1",
    "x2_krippendorff": f"with {J}, {KRIPP('j')} select * from kk",
    "x3_spearman": f"with {SCORED}, r as (select lang, {MID('score', 'lang')} as rx, {MID('n_chars', 'lang')} as ry from s) select lang, count(*) as n, {R('corr(rx, ry)', 5)} as rho from r group by lang",
    "x4_cliffs_delta": f"with {SCORED}, {AUC('lang')} select lang, pos, neg, {R('2 * auc - 1', 5)} as delta from a",
    "x5_cohesion": f"with n as (select label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings), e as (select label, n > 0 as has, generate_subscripts(embedding, 1) as i, case when n > 0 then unnest(embedding)::double / n else 0 end as x from n), g as (select label, i, sum(x) as s, count(*) as n, count(*) filter (where has) as k from e group by all) select label, max(n) as n, case when max(n) >= 2 then {R('(sum(s * s) - max(k)) / (max(n) * (max(n) - 1.0))', 5)} end as cohesion from g group by label",
    "x6_panel_score": f"with {J} {PANEL('true', 2)}",
    "x7_efficacy": f"with {PAIRS} select item % 3 as block, count(*) as n, {R('avg(before)', 4)} as before, {R('avg(after)', 4)} as after, {R('avg(after - before)', 4)} as delta, {R('avg((after < before)::int)', 4)} as fell from pr group by 1",
    "x8_agreement": f"with {PAIRS}, lg as (select item, unnest([before, after]) as value from pr), {KRIPP('lg')}, r as (select {MID('before', '1')} as rx, {MID('after', '1')} as ry from pr) select units, ratings, alpha, (select count(*) from r) as n, (select {R('corr(rx, ry)', 5)} from r) as rho, (select {R('avg(abs(before - after))', 4)} from pr) as mean_gap from kk",
    "x9_paired_delta": f"with {PAIRS}, o as (select case when item % 2 = 0 then 'ai' else 'human' end as class, before_judges >= 2 and after_judges >= 2 as ok, after - before as dl from pr) select class, count(*) filter (where ok) as pairs, count(*) filter (where not ok) as lost, {R('avg(case when ok then dl end)', 4)} as delta from o group by class",
    "x10_classify_cues": f"with c as (select case {' '.join(f'''when regexp_matches(lower(text), '{p}') then '{c}' ''' for c, p in CUES)} else 'other' end as cue from documents), g as (select cue, count(*) as n from c group by cue) select *, {R('n::double / (select sum(n) from g)', 5)} as share from g",
    "x11_judge_measures": f"""with {J}, r as (select l_returnflag as judge, case when l_returnflag = 'A' then 'f1' else 'f2' end as jf, item // 10 as item, judge % 2 = 1 as first, value * 10.0 as score, value * 10.0 >= 50 as called, l_linestatus = 'O' as expected, 'f' || (item % 3) as family from j),
s as (select * from r where first and (not expected or family <> jf)), b as (select judge, count(*) as n, {R('avg((called = expected)::int)', 5)} as accuracy, {R('avg(score) filter (where not expected)', 4)} as bias_human, {R('avg(score) filter (where expected)', 4)} as bias_ai from s group by judge), {AUC('judge')},
sd as (select judge, {R('median(sd)', 4)} as repeat_sd from (select judge, item, count(*) as k, stddev_samp(score) as sd from r group by all having count(*) >= 5) group by judge), own as (select judge, avg(score) as own from r where first and expected and family = jf group by judge),
x as (select b.*, auc, repeat_sd, {R('own - bias_ai', 4)} as self_preference from b join a using (judge) left join sd using (judge) left join own using (judge))
select *, case when auc < 0.65 or repeat_sd > 20 then 'DEMOTE' when auc >= 0.75 and repeat_sd <= 12 then 'PASS' else 'WATCH' end as verdict from x""",
    "x12_merge_repeats": f"with {J} select item, count(*) as n, {R('median(value)', 4)} as median, {R('max(value) - min(value)', 4)} as spread, max_by(l_returnflag, case l_returnflag when 'N' then 1 when 'R' then 2 when 'A' then 3 end) as worst from j group by item",
}
