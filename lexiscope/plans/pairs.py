"""Queries over pairs of texts, retrieval and the structural model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators import model as M
from lexiscope.operators import pairs as P
from lexiscope.operators import similarity as Y
from lexiscope.operators import style as S
from lexiscope.plans import sql as Q
from lexiscope.plans.evaluation import SCORED, scored
from lexiscope.plans.style import WORDS
from lexiscope.plans.verdicts import TURNS, turns
from lexiscope.session import materialise, table

r6 = Q.r6
MODEL = M.Model((0.4, -0.02, 0.01, 1.5, -2.0, 0.7, 0.1, -0.3, 2.0, -0.5, 0.0, 3.0), -0.2, (0.5, 10.0, 5.0, 0.6, 0.8, 0.7, 5.0, 0.5, 0.05, 0.8, 0.1, 0.01), (0.2, 5.0, 3.0, 0.2, 0.1, 0.2, 1.0, 0.5, 0.03, 0.2, 1.0, 0.02), 0.6)
TARGETS = [("p1", "burstiness_cv", 0.5, 0.2, 1.0), ("p1", "mattr", 0.8, 0.1, 2.0), ("p1", "overEditChurn", 0.45, 0.0, 0.0), ("p2", "sentence_opener_diversity", 0.9, 0.2, 1.0), ("p2", "comma_per_sentence", 0.3, 0.3, 0.5), ("p2", "lexicon_density_avoid", 20.0, 5.0, 0.3), ("p2", "lexicon_density_preferred", 40.0, 30.0, 0.2)]


def talk(spark, d):
    """Neighbouring turns as pairs; the key tells conversation and turn."""
    return turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("en").alias("lang"), "original", "rewrite")


def edited(spark, d):
    """A document and itself without marks and its last quarter."""
    x = table(spark, d, "documents")
    return x.select("doc_id", "lang", F.col("text").alias("original"), T.strip_punct(F.substr("text", F.lit(1), (F.char_length("text") * 3 / 4).cast("int"))).alias("rewrite"))


def numbered(spark, d):
    """Documents and their rewrites: a document against itself with sevens turned to eights in every third one."""
    x = table(spark, d, "documents")
    return x.select("doc_id", "lang", F.col("text").alias("original"), F.when(F.col("doc_id") % 3 == 0, F.translate("text", "7", "8")).otherwise(F.col("text")).alias("rewrite"))


def claims(spark, d):
    return P.numeric_claims(table(spark, d, "documents"), ["doc_id"]).select("doc_id", F.size("claims").alias("n"), F.size(F.array_distinct("claims")).alias("kinds"), "reason")


def quality(spark, d):
    x = scored(spark, d)
    return P.rewrite_quality(x.select("doc_id", F.col("score").alias("before"), (F.col("score") * 0.7).alias("after"), (F.col("doc_id") % 5).alias("facts"), F.least(F.col("doc_id") % 5, F.col("doc_id") % 4).alias("kept"), (F.pmod("n_chars", F.lit(250)) / 100.0).alias("ratio")))


def anchors(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.slice(F.split("text", r"[ \n]+", -1), 1, 6).alias("anchors"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.expr("substring(text, 20)")).alias("rewrite"))
    return P.anchor_mps(x, "doc_id")


def entries(spark, d):
    """Order lines as rewrites of an item by several configurations."""
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("item"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("config"), F.col("l_quantity").cast("double").alias("score"), (F.pmod("l_partkey", F.lit(60)) + 41).cast("double").alias("mps"), (F.pmod("l_suppkey", F.lit(50)) + 51).cast("double").alias("fidelity"), (F.col("l_discount") * 10).cast("double").alias("churn"))


def trace(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    w = (F.lit(100.0) - 12 * F.col("l_linenumber") + F.pmod("l_partkey", F.lit(9))).alias("after")
    y = x.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("int").alias("iteration"), w, (F.pmod("l_suppkey", F.lit(40)) + 64).cast("double").alias("fidelity"), F.when(F.col("l_partkey") % 17 != 0, (F.pmod("l_partkey", F.lit(40)) + 65).cast("double")).alias("mps"))
    y = y.withColumn("before", F.col("after") + 5 - F.pmod("item", F.lit(5))).withColumn("combined", F.col("after") * 0.6 + (100 - F.col("fidelity")) * 0.4)
    return P.select_iteration(y, "item")


def rounds(spark, d):
    x = table(spark, d, "lineitem").select(F.pmod("l_orderkey", F.lit(20)).alias("study"), F.col("l_linenumber").alias("round"), (F.col("l_quantity") * 1.0).cast("double").alias("treat_match"), (F.pmod("l_partkey", F.lit(40))).cast("double").alias("base_match"), (F.pmod("l_suppkey", F.lit(60)) + 55).cast("double").alias("base_mps"), (F.pmod("l_partkey", F.lit(60)) + 55).cast("double").alias("treat_mps"), F.lit(80.0).alias("base_fidelity"), F.lit(80.0).alias("treat_fidelity"), F.lit(0.2).alias("base_churn"), (F.col("l_discount") * 6).cast("double").alias("treat_churn"))
    return P.ablation_aggregate(x.withColumn("winner", F.when(F.col("treat_match") > F.col("base_match"), "treatment").otherwise("baseline")), ["study", "round"])


def variants(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(100)).cast("double").alias("base_match"), F.pmod("l_suppkey", F.lit(100)).cast("double").alias("treat_match"), (F.col("l_linenumber") % 3 != 0).alias("base_ok"), (F.col("l_linenumber") % 2 != 0).alias("treat_ok"))
    return P.compare_variants(x).groupBy("winner").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("delta"))


def grader(spark, d):
    return P.grader_check(entries(spark, d).withColumn("expected", F.when(F.col("item") % 2 == 0, "pass").otherwise("fail")))


def matched(spark, d):
    t = spark.createDataFrame(TARGETS, "persona_id string, feature string, target double, tolerance double, weight double")
    x = S.persona_features(table(spark, d, "documents"), *WORDS).withColumn("churn", F.pmod("doc_id", F.lit(10)) / 10.0)
    return P.persona_match(x, list(S.PERSONA), t)


def messages(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lower("text").alias("text"))


def found(spark, d):
    """Nearest turns of every benchmark item."""
    m = messages(spark, d)
    counted = Y.frequencies(m, "doc_id")
    w = materialise(Y.idf(m, "doc_id", counted=counted))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.lower("text").alias("text"))
    return Y.retrieve(Y.tfidf(q, w, "query"), Y.tfidf(m, w, "doc_id", counted=counted), 3)


def index(spark, d):
    m = messages(spark, d)
    counted = Y.frequencies(m, "doc_id")
    return Y.tfidf(m, Y.idf(m, "doc_id", counted=counted), "doc_id", counted=counted).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("w"), 5).alias("top"))


def features(spark, d):
    return S.structural_features(table(spark, d, "documents"))


def labelled(spark, d):
    return features(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("bad", F.col("quality") == 0)


def trained(spark, d):
    x = materialise(labelled(spark, d).select("doc_id", "bad", *S.FEATURES))  # the scaler, the fit and the scores read it
    return x.select("doc_id", F.col("bad").alias("expected"), F.round(M.predict(M.train(x, "bad")), 3).alias("score"))


def verdicts(spark, d):
    x = features(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return M.verdict(x, M.Model(MODEL.weights, MODEL.bias, MODEL.mu, MODEL.sigma, 0.6, "en")).select("doc_id", F.round("model_score", 4).alias("model_score"), "model_hot")


QUERIES = {
    "p1_numeric_claims": claims,
    "p2_number_safety": lambda s, d: P.number_safety(numbered(s, d), "doc_id"),
    "p3_dropped_numbers": lambda s, d: P.dropped_numbers(numbered(s, d)).select("doc_id", F.size("dropped").alias("n")),
    "p4_rare_token_recall": lambda s, d: P.rare_token_recall(edited(s, d), "doc_id"),
    "p5_negations": lambda s, d: talk(s, d).select("id", P.negations("original").alias("before"), P.negations("rewrite").alias("after")),
    "p6_length_ratio": lambda s, d: talk(s, d).select("id", F.round(P.length_ratio(F.size(T.tokenize("original")), F.size(T.tokenize("rewrite"))), 5).alias("ratio")),
    "p7_meaning_proxy": lambda s, d: P.meaning_proxy(edited(s, d), "doc_id"),
    "p7_meaning_signals": lambda s, d: P.meaning_proxy(edited(s, d), "doc_id").select("doc_id", "dropped", "negation_delta", "ratio", "recall"),
    "p8_anchor_mps": anchors,
    "p9_rewrite_quality": quality,
    "p10_edit_churn": lambda s, d: talk(s, d).select("id", F.round(P.edit_churn("original", "rewrite"), 6).alias("churn"), F.round(P.edit_churn("original", "rewrite", "sum"), 6).alias("churn_sum")),
    "p12_persona_match": matched,
    "p13_persona_gate": lambda s, d: P.persona_gate(matched(s, d).withColumn("churn", F.pmod("doc_id", F.lit(10)) / 10.0)).groupBy("advice", "passed").agg(F.count("*").alias("n")),
    "p14_derive_targets": lambda s, d: P.derive_targets(S.persona_features(table(s, d, "documents"), *WORDS)),
    "p15_ablation_aggregate": rounds,
    "p16_ablation_decision": lambda s, d: P.ablation_decision(rounds(s, d), ["study"], "round"),
    "p17_recommend_thresholds": lambda s, d: P.recommend_thresholds(entries(s, d), "config", "score"),
    "p18_pick_winner": lambda s, d: P.pick_winner(entries(s, d), "item").select("item", "config", "score"),
    "p19_ab_summary": lambda s, d: P.ab_summary(entries(s, d), "item"),
    "p20_select_iteration": trace,
    "p21_block_diff": lambda s, d: P.diff(talk(s, d), "id", "block").groupBy("id", "kind").agg(F.count("*").alias("n")),
    "p22_word_diff": lambda s, d: P.diff(talk(s, d), "id", "word").groupBy("id", "kind").agg(F.count("*").alias("n")),
    "p23_align_blocks": lambda s, d: P.align_blocks(edited(s, d).select("doc_id", "original", "rewrite"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("dice"), 4).alias("dice")),
    "p24_compare_variants": variants,
    "p25_grader_check": grader,
    "p26_size_delta": lambda s, d: P.size_delta(talk(s, d)).select("id", "chars_delta", "words_delta"),
    "q1_tfidf": index,
    "q2_retrieve": found,
    "q3_dice": lambda s, d: Y.dice(talk(s, d), "id", "original", "rewrite"),
    "m1_fit_scaler": lambda s, d: M.fit_scaler(features(s, d)),
    "m2_train": trained,
    "m3_predict": lambda s, d: features(s, d).select("doc_id", F.round(M.predict(MODEL), 4).alias("score")),
    "m4_threshold_for_fpr": lambda s, d: M.threshold_for_fpr(scored(s, d).select("lang", "expected", (F.col("score") / 100).alias("score")), 0.05, ["lang"]),
    "m5_verdict": verdicts,
}

TALK = f"{TURNS}, tk as (select conv_id * 1000 + turn as id, original, rewrite from tu where rewrite is not null)"
STRIP = r"regexp_replace({}, '[.,!?;:()\[\]{{}}" + '"' + r"''…—–\-。！？、]', '', 'g')"
EDIT = f"ed as (select doc_id, text as original, {STRIP.format('left(text, (length(text) * 3) // 4)')} as rewrite from documents)"
NUMS = "list_distinct(list_transform(regexp_extract_all({}, '[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')))"
NEG = "len(list_filter(regexp_extract_all(lower({}), '[a-z]+(?:''[a-z]+)?'), lambda w: w in (" + ", ".join(f"'{w}'" for w in P.NEGATIONS) + ") or ends_with(w, 'n''t')))"
CONTENT = lambda c: f"list_filter(list_transform({Q.tokens(c)}, lambda t: lower(t)), lambda t: length(t) >= 2)"
RARE = f"""{EDIT}, rx as (select doc_id, lower(rewrite) as r, {CONTENT('original')} as o, {CONTENT('rewrite')} as t, len({Q.tokens('original')}) as no, len({Q.tokens('rewrite')}) as nr, original, rewrite from ed),
rw as (select doc_id, unnest(o) as w from rx), rc as (select doc_id, w from rw group by all having count(*) <= 2), rl as (select doc_id, list(w) as ws from rc group by doc_id),
rr as (select doc_id, len(coalesce(ws, [])) as rare, len(list_filter(coalesce(ws, []), lambda w: list_contains(t, w) or (length(w) >= 5 and contains(r, w)))) as survived from rx left join rl using (doc_id)),
ra as (select *, case when rare >= 3 then {r6('survived::double / rare')} end as recall from rr)"""
ENT = "en as (select l_orderkey as item, 'c' || l_linenumber as config, l_quantity::double as score, (l_partkey % 60 + 41)::double as mps, (l_suppkey % 50 + 51)::double as fidelity, (l_discount * 10)::double as churn from lineitem), wn as (select * from en where mps >= 70 and fidelity >= 70 qualify row_number() over (partition by item order by score, churn, config) = 1)"
ROUNDS = f"""rd as (select l_orderkey % 20 as study, l_linenumber as round, l_quantity::double as tm, (l_partkey % 40)::double as bm, (l_suppkey % 60 + 55) as bmps, (l_partkey % 60 + 55) as tmps, (l_discount * 6)::double as tc from lineitem),
rg as (select study, round, avg(tm - bm) as delta, avg((tm > bm)::int) as wins, avg((bmps >= 70)::int) - avg((tmps >= 70)::int) as lm, 1 - avg((tc <= 0.45)::int) as lc from rd group by all),
ag as (select study, round, {r6('delta', 4)} as delta, {r6('wins', 4)} as wins, {r6('greatest(lm, lc, 0)', 4)} as safety_drop, delta >= 5 and wins >= 0.55 and lm <= 0.01 and lc <= 0.03 as passes from rg)"""
TERMS = r"list_concat(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), list_filter(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), lambda b: not regexp_matches(b, '^\s+$')))"
INDEX = f"""ms as (select conv_id * 1000 + turn as doc_id, lower(text) as text from conversations), mt as (select doc_id, unnest({TERMS}) as term from ms),
df as (select term, count(distinct doc_id) as df from mt group by term), wt as (select term, ln(((select count(*) from ms) + 1) / (df + 1)::double) + 1 as idf from df),
mf as (select doc_id, term, count(*) as f from mt group by all), mv as (select doc_id, term, (1 + ln(f)) * idf as v from mf join wt using (term)), mw as (select doc_id, term, v / sqrt(sum(v * v) over (partition by doc_id)) as w from mv)"""
Z = " + ".join(f"{w} * (({n}) - {m}) / {s}" for n, w, m, s in zip(S.FEATURES, MODEL.weights, MODEL.mu, MODEL.sigma, strict=True))


def feats() -> str:
    from lexiscope.plans.style import ORACLES as style

    return f"ft as ({style['a13_structural_features']})"


def persona() -> str:
    from lexiscope.plans.style import ORACLES as style

    t = ", ".join(f"('{a}', '{b}', {c}::double, {e}::double, {w}::double)" for a, b, c, e, w in TARGETS)
    long = " union all ".join(f"select doc_id, '{n}' as feature, {n} as x from pf" for n in S.PERSONA)
    return f"""pf as ({style['a17_persona_features']}), lg as ({long}), tg as (select * from (values {t}) v(persona_id, feature, target, tolerance, weight)),
pj as (select doc_id, persona_id, x, target, weight, greatest(-3, least(3, (x - target) / nullif(tolerance, 0))) as z from lg join tg using (feature) where weight > 0 and tolerance > 0),
pg as (select doc_id, persona_id, sqrt(sum(weight * z * z) / sum(weight)) as d, sum(x * weight * target * weight) as dot, sum(x * weight * x * weight) as xx, sum(target * weight * target * weight) as tt from pj group by all),
pb as (select persona_id, max(target) filter (where feature = 'lexicon_density_avoid') as goal, max(tolerance) filter (where feature = 'lexicon_density_avoid') as al, max(target) filter (where feature = 'overEditChurn') as cm from tg group by 1),
pq as (select pg.*, greatest(0, lexicon_density_avoid - coalesce(goal, 0) - coalesce(al, 1)) / greatest(coalesce(al, 1), 1) * 5 as ap, case when (doc_id % 10) / 10.0 > cm then ((doc_id % 10) / 10.0 - cm) / greatest(cm, 0.01) * 20 else 0 end as cp from pg join pb using (persona_id) join pf using (doc_id)),
ps as (select doc_id, persona_id, {r6('greatest(0, least(100, 80 * (1 - least(d, 3) / 3) + 20 * greatest(case when xx > 0 and tt > 0 then dot / (sqrt(xx) * sqrt(tt)) else 0 end, 0) - least(20, ap) - least(20, cp)))', 4)} as score from pq)"""


def derived() -> str:
    from lexiscope.plans.style import ORACLES as style

    return f"with pf as ({style['a17_persona_features']}) " + " union all ".join(f"select '{n}' as feature, {r6(f'avg({n})', 5)} as target, {t} as tolerance, 0.1 as weight from pf" for n, t in P.TOLERANCES.items())


ORACLES = {
    "p3_dropped_numbers": f"with x as (select doc_id, text as o, case when doc_id % 3 = 0 then translate(text, '7', '8') else text end as r from documents) select doc_id, len(list_filter({NUMS.format('o')}, lambda v: not list_contains({NUMS.format('r')}, v))) as n from x",
    "p4_rare_token_recall": f"with {RARE} select * from ra",
    "p5_negations": f"with {TALK} select id, {NEG.format('original')} as before, {NEG.format('rewrite')} as after from tk",
    "p6_length_ratio": f"with {TALK}, n as (select id, len({Q.tokens('original')}) as a, len({Q.tokens('rewrite')}) as b from tk) select id, round(case when a > 0 then b::double / a when b = 0 then 1 else 'inf'::double end, 5) as ratio from n",
    "p7_meaning_signals": f"""with {RARE}, x as (select doc_id, len(list_filter({NUMS.format('original')}, lambda v: not list_contains({NUMS.format('rewrite')}, v))) as dropped, {NEG.format('rewrite')} - {NEG.format('original')} as negation_delta, case when no > 0 then nr::double / no when nr = 0 then 1 else 'inf'::double end as ratio, recall from rx join ra using (doc_id))
select doc_id, dropped, negation_delta, {r6('ratio', 4)} as ratio, recall from x""",
    "p8_anchor_mps": rf"with x as (select doc_id, string_split_regex(text, '[ \n]+')[1:6] as a, lower({Q.trim(r'''regexp_replace(case when doc_id % 2 = 0 then text else substr(text, 20) end, '\s+', ' ', 'g')''')}) as r from documents), y as (select doc_id, len(a) as anchors, len(list_filter(a, lambda v: contains(r, lower(trim(v))))) as passed from x) select *, {r6('passed * 100.0 / nullif(anchors, 0)', 4)} as mps from y",
    "p9_rewrite_quality": f"with {SCORED}, x as (select doc_id, score as before, score * 0.7 as after, doc_id % 5 as facts, least(doc_id % 5, doc_id % 4) as kept, (n_chars % 250) / 100.0 as ratio from s), y as (select *, {r6('least(coalesce(kept * 100.0 / nullif(facts, 0), 100), case when ratio between 0.7 and 1.3 then 100 when ratio between 0.5 and 1.5 then 80 when ratio between 0.3 and 2 then 60 when ratio > 0 then 30 else 0 end)', 1)} as safety from x), z as (select *, {r6(f"greatest({r6('before - after', 1)}, 0) * safety / 100", 1)} as gain from y) select *, case when safety >= 70 and gain > 0 then case when after <= 30 then 'pass' else 'warn' end else 'fail' end as quality from z",
    "p12_persona_match": f"with {persona()} select * from ps",
    "p13_persona_gate": f"with {persona()}, g as (select array_to_string(list_filter([case when score < 70 then 'match' end, case when (doc_id % 10) / 10.0 > 0.45 then 'churn' end], lambda v: v is not null), ',') as advice from ps) select advice, advice = '' as passed, count(*) as n from g group by 1",
    "p14_derive_targets": derived(),
    "p15_ablation_aggregate": f"with {ROUNDS} select * from ag",
    "p16_ablation_decision": f"with {ROUNDS}, f as (select *, not passes or delta < 3 or wins < 0.52 or safety_drop > 0.03 as fail from ag), t as (select *, fail and coalesce(lag(fail) over (partition by study order by round), false) as twice from f) select study, case when bool_or(twice) then 'fallback-bridge-only' when bool_or(not fail) then 'promote-thresholds' else 'keep-placeholder' end as decision from t group by study",
    "p17_recommend_thresholds": f"with {ENT}, r as (select config, score, row_number() over (partition by config order by score) - 1 as r, count(*) over (partition by config) as n from en) select config, n, greatest(70, floor(score))::double as threshold from r where r = greatest(floor(n * 0.25) - 1, 0)",
    "p18_pick_winner": f"with {ENT} select item, config, score from wn",
    "p19_ab_summary": f"with {ENT}, b as (select item, score as base from en where config = (select min(config) from en)), g as (select config, count(*) as n, {r6('avg(score)', 4)} as score, {r6('avg(churn)', 4)} as churn, {r6('avg(score - base)', 4)} as delta from en left join b using (item) group by config), w as (select config, count(*) as wins from wn group by config) select g.*, coalesce(wins, 0) as wins from g left join w using (config)",
    "p20_select_iteration": """with x as (select l_orderkey as item, l_linenumber as iteration, 100.0 - 12 * l_linenumber + l_partkey % 9 as after, l_suppkey % 40 + 64 as fidelity, case when l_partkey % 17 <> 0 then l_partkey % 40 + 65 end as mps from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by all)),
y as (select *, after + 5 - item % 5 as before, after * 0.6 + (100 - fidelity) * 0.4 as combined from x), z as (select *, lag(combined) over (partition by item order by iteration) as pv from y),
r as (select *, case when fidelity < 70 then 'fidelity-floor' when mps is null then 'mps-failure' when mps < 70 then 'mps-floor' when after <= 30 then 'target' when round(pv - combined, 6) < 0 then 'regression' when before - after <= 2 then 'plateau' when iteration >= 5 then 'max-iterations' end as reason from z),
s as (select *, min(case when reason is not null then iteration end) over (partition by item) as stop from r), k as (select * from s where stop is null or iteration <= stop),
a as (select item, max(stop) as stop, arg_max(reason, iteration) filter (where stop is not null and iteration = stop) as reason, arg_min(before, iteration) as start, min(struct_pack(a := after, i := iteration)) filter (where coalesce(reason, '') not in ('fidelity-floor', 'mps-failure', 'mps-floor', 'regression')) as best from k group by item)
select item, stop, coalesce(reason, 'completed') as reason, case when coalesce(best.a < start, false) then best.a else start end::double as score, case when coalesce(best.a < start, false) then best.i else 0 end as iteration from a""",
    "p24_compare_variants": f"with x as (select (l_partkey % 100)::double as b, (l_suppkey % 100)::double as t, l_linenumber % 3 <> 0 as bo, l_linenumber % 2 <> 0 as too from lineitem), y as (select {r6('t - b', 4)} as delta, case when too and not bo then 'treatment' when bo and not too then 'baseline' when t > b then 'treatment' when t < b then 'baseline' else 'tie' end as winner from x) select winner, count(*) as n, round(avg(delta), 4) as delta from y group by winner",
    "p25_grader_check": f"with {ENT}, x as (select mps >= 70 and fidelity >= 70 as ok, item % 2 = 0 as good from en) select count(*) as n, count(*) filter (where ok = good) as right, count(*) filter (where ok and not good) as dangerous, count(*) filter (where not ok and good) as blocking from x",
    "p26_size_delta": rf"with {TALK} select id, length(rewrite) - length(original) as chars_delta, len(list_filter(string_split_regex(rewrite, '\s+'), lambda x: x <> '')) - len(list_filter(string_split_regex(original, '\s+'), lambda x: x <> '')) as words_delta from tk",
    "q1_tfidf": f"with {INDEX} select doc_id, count(*) as terms, round(max(w), 5) as top from mw group by doc_id",
    "q2_retrieve": f"with {INDEX}, qt as (select query, unnest({TERMS}) as term from (select item_id as query, lower(text) as text from benchmark)), qf as (select query, term, count(*) as f from qt group by all), qv as (select query, term, (1 + ln(f)) * idf as v from qf join wt using (term)), qw as (select query, term, v / sqrt(sum(v * v) over (partition by query)) as w from qv), sc as (select query, doc_id, {r6('sum(qw.w * mw.w)', 5)} as score from qw join mw using (term) group by all) select query, doc_id, score, row_number() over (partition by query order by score desc, doc_id) as rank from sc where score >= 0.05 qualify rank <= 3",
    "q3_dice": f"with {TALK}, g as (select id, 1 as side, unnest(list_transform(range(1, length(original)), lambda i: substr(lower(original), i, 2))) as g from tk union all select id, 2, unnest(list_transform(range(1, length(rewrite)), lambda i: substr(lower(rewrite), i, 2))) from tk), n as (select id, g, count(*) filter (where side = 1) as a, count(*) filter (where side = 2) as b from g group by all), s as (select id, sum(least(a, b)) as n, sum(a + b) as t from n group by id) select tk.id, {r6('case when coalesce(t, 0) > 0 then 2.0 * n / t else (lower(original) = lower(rewrite))::int end')} as dice from tk left join s using (id)",
    "m1_fit_scaler": f"with {feats()} " + " union all ".join(f"select '{n}' as feature, {r6(f'avg({n})', 5)} as mu, {r6(f'case when {r6(f'stddev_pop({n})', 5)} > 0 then stddev_pop({n}) else 1 end', 5)} as sigma from ft" for n in S.FEATURES),
    "m3_predict": f"with {feats()} select doc_id, round(1 / (1 + exp(-({Z} + {MODEL.bias}))), 4) as score from ft",
    "m4_threshold_for_fpr": f"with {SCORED}, r as (select lang, score / 100 as score, row_number() over (partition by lang order by score) as r, count(*) over (partition by lang) as n from s where not expected) select lang, greatest(0.5, score) as threshold from r where r = least(greatest(ceil(0.95 * n), 1), n)",
    "m5_verdict": f"with {feats()}, x as (select ft.doc_id, case when lang = 'en' then {r6(f'1 / (1 + exp(-({Z} + {MODEL.bias})))')} end as m from ft join documents using (doc_id)) select doc_id, round(m, 4) as model_score, m >= 0.6 as model_hot from x",
}
