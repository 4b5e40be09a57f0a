"""Queries over segments and stylometric measures, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators import style as S
from lexiscope.plans import sql as Q
from lexiscope.session import table

RULES = [("plain", r"[aeiouáéíóú]$"), ("closed", r"[ndrst]$"), ("mark", r"[^a-zA-Z]$")]


WORDS = (["the ", "tion"], ["and", "ing "])  # preferred and avoided phrases


def docs(spark, d):
    return table(spark, d, "documents")


def lines(spark, d):
    return S.units(docs(spark, d), "line")


def paras_mattr(spark, d):
    return S.mattr(lines(spark, d), ["doc_id", "para_idx"], 20)


def first_slice(spark, d):
    b = S.burstiness(S.document_units(docs(spark, d)))
    return b.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("cv_band") == "low").alias("n_low"), F.round(F.avg("cv"), 4).alias("mean_cv"))


def long_sentence_runs(spark, d):
    x = S.document_units(docs(spark, d)).select("doc_id", F.size("counts").alias("n"), S.longest_stretch("counts", lambda n: n > 12).cast("long").alias("longest_run"))
    # a text without sentences goes by an empty list, as a filter would be pushed below the counts and cut it twice
    return x.select("doc_id", F.inline(F.filter(F.array(F.struct("n", "longest_run")), lambda r: r["n"] > 0))).drop("n")


def dominant(spark, d):
    rows = S.document_units(docs(spark, d)).select("doc_id", F.explode("sentences").alias("sentence"))
    return S.dominant_class(rows, ["doc_id"], RULES)


def zoom(spark, d):
    u = lines(spark, d)
    return S.sentence_zoom(u, F.size("counts") >= 3)


def column(name, expr):
    return lambda spark, d: docs(spark, d).select("doc_id", expr().alias(name))


def coded(expr):
    """A list as its length and a digest, so that texts stay out of the result."""
    return [F.size(expr).alias("n"), F.md5(F.array_join(expr, "\x1f").cast("binary")).alias("digest")]


def listed(expr):
    return lambda spark, d: docs(spark, d).select("doc_id", *coded(expr()))


def list_sql(expr):
    return f"select doc_id, len({expr}) as n, md5(array_to_string({expr}, chr(31))) as digest from documents"


QUERIES = {
    "a0_low_burstiness_by_lang": first_slice,
    "a1_burstiness": lambda s, d: S.burstiness(lines(s, d)).select("doc_id", "para_idx", "n_sentences", "cv", "cv_band"),
    "a2_mattr": lambda s, d: S.mattr(S.document_units(docs(s, d)), ["doc_id"], 50).withColumn("mattr_band", S.band(F.col("mattr"), S.MATTR_LOW, S.MATTR_HIGH)),
    "a2_mattr_lines": paras_mattr,
    "a4_comma_density": lambda s, d: S.comma_density(lines(s, d)).select("doc_id", "para_idx", "per_sentence", "per_100_chars"),
    "a11_longest_run": long_sentence_runs,
    "a13_structural_features": lambda s, d: S.structural_features(docs(s, d)),
    "a14_dominant_class": dominant,
    "a15_style_vector": lambda s, d: S.style_vector(docs(s, d)),
    "a16_opener_diversity": lambda s, d: S.opener_diversity(lines(s, d)).select("doc_id", "para_idx", "opener_diversity"),
    "a17_persona_features": lambda s, d: S.persona_features(docs(s, d), *WORDS),
    "a19_sentence_zoom": zoom,
    "a20_bigram_redundancy": lambda s, d: S.ngram_redundancy(lines(s, d), 2).select("doc_id", "para_idx", "redundancy"),
    "a20_trigram_redundancy": lambda s, d: S.ngram_redundancy(lines(s, d), 3).select("doc_id", "para_idx", "redundancy"),
    "n1_nfc": column("digest", lambda: F.md5(T.nfc("text").cast("binary"))),
    "n2_strip_markdown": column("digest", lambda: F.md5(T.strip_markdown("text").cast("binary"))),
    "n4_strip_esm": column("digest", lambda: F.md5(T.strip_esm("text").cast("binary"))),
    "n5_paragraphs": listed(lambda: T.split_paragraphs("text")),
    "n5_lines": listed(lambda: T.split_paragraphs("text", "line")),
    "n6_strip_list_blocks": column("digest", lambda: F.md5(T.strip_lists("text").cast("binary"))),
    "n7_sentences": listed(lambda: T.split_sentences("text")),
    "n8_tokens": listed(lambda: T.tokenize("text", F.col("lang"))),
    "n9_detect_language": column("detected", lambda: T.detect_language("text", "source")),
    "n11_zero_width": column("n_marks", lambda: F.regexp_count(T.zero_width("text"), F.lit(T.ZERO_WIDTH))),
    "n12_homoglyph": column("digest", lambda: F.md5(T.homoglyph("text").cast("binary"))),
    "n13_upper": column("digest", lambda: F.md5(F.upper("text").cast("binary"))),
    "n14_strip_punct": column("digest", lambda: F.md5(T.strip_punct("text").cast("binary"))),
    "n15_repeat_sentences": column("n_chars2", lambda: F.char_length(T.repeat_sentences("text"))),
    "n16_text_hash": column("text_hash", lambda: T.text_hash("text")),
    "n17_redact": column("digest", lambda: F.md5(T.redact("text").cast("binary"))),
    "n18_length_bucket": lambda s, d: docs(s, d).groupBy(T.bucket("n_chars", [500, 2000, 8000], ["short", "medium", "long", "xlong"]).alias("bucket")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
    "n19_is_short": column("is_short", lambda: T.is_short("text")),
    "n20_norm_match": column("digest", lambda: F.md5(T.norm_match("text").cast("binary"))),
    "n21_snippet": column("digest", lambda: F.md5(T.snippet("text", 300).cast("binary"))),
}

R = Q.r6
LOW = "list_transform(tokens, lambda t: lower(t))"


def grams(n):
    return f"""with {Q.units()},
g as (select doc_id, para_idx, case when len(tokens) >= {n} then list_transform(range(1, len(tokens) - {n - 2}), lambda i: array_to_string(list_slice({LOW}, i, i + {n - 1}), ' ')) else [] end as g from u)
select doc_id, para_idx, {R("1 - len(list_distinct(g))::double / nullif(len(g), 0)")} as redundancy from g"""


def places(words):
    return " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words)


NOSPACE = r"length(regexp_replace(text, '\s+', '', 'g'))"
PIECES = r"regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+$')"
SECRET_SQL = "text"
for _p in T.SECRETS:
    _flags = "gi" if _p.startswith("(?i)") else "g"
    SECRET_SQL = f"regexp_replace({SECRET_SQL}, '{_p.removeprefix('(?i)')}', '{T.REDACTED}', '{_flags}')"

ORACLES = {
    "a0_low_burstiness_by_lang": f"with {Q.whole()}, c as (select lang, len(counts) as k, {R(Q.CV)} as cv from d) select lang, count(*) as n, count(*) filter (where k >= 3 and cv < 0.3) as n_low, round(avg(cv), 4) as mean_cv from c group by lang",
    "a1_burstiness": f"with {Q.units()}, c as (select doc_id, para_idx, len(counts) as n_sentences, {R(Q.CV)} as cv from u) select *, case when n_sentences >= 3 then {Q.band('cv', 0.3, 0.5)} end as cv_band from c",
    "a2_mattr": f"with {Q.whole()}, {Q.mattr('d', 'doc_id', 50)} select *, {Q.band('mattr', 0.55, 0.70)} as mattr_band from m",
    "a2_mattr_lines": f"with {Q.units()}, {Q.mattr('u', 'doc_id, para_idx', 20)} select * from m",
    "a4_comma_density": f"with {Q.units()}, c as (select *, length(text) - length(replace(replace(text, ',', ''), '，', '')) as k from u) select doc_id, para_idx, {R('k::double / nullif(len(sentences), 0)')} as per_sentence, {R(f'k * 100.0 / nullif({NOSPACE}, 0)')} as per_100_chars from c",
    "a11_longest_run": f"""with {Q.whole()}, r as (select doc_id, generate_subscripts(counts, 1) as pos, unnest(counts) > 12 as long from d),
g as (select *, row_number() over (partition by doc_id order by pos) - sum(long::int) over (partition by doc_id order by pos) as g from r),
k as (select doc_id, g, count(*) filter (where long) as n from g group by doc_id, g) select doc_id, max(n) as longest_run from k group by doc_id""",
    "a13_structural_features": rf"""with {Q.whole()}, {Q.mattr('d', 'doc_id', 40)},
f0 as (select doc_id, unnest(tokens) as token from d), f1 as (select doc_id, token, count(*) as c from f0 group by all), f as (select doc_id, count(*) as types, count(*) filter (where c = 1) as hapax from f1 group by doc_id),
x as (select d.doc_id, d.text, tokens, sentences, list_filter(counts, lambda c: c > 0) as counts, regexp_replace(d.text, '\s+', '', 'g') as compact,
  list_filter(list_transform(sentences, lambda s: right(regexp_replace(right(s, 3), '[.!?]', '', 'g'), 2)), lambda s: s <> '') as ends, types, hapax, m.mattr from d left join f using (doc_id) left join m using (doc_id))
select doc_id, {R(f'coalesce({Q.CV}, 0)')} as burstiness_cv, {R('coalesce(list_sum(counts)::double / nullif(len(counts), 0), 0)')} as mean_sent_len,
 {R(f'case when len(counts) >= 2 then sqrt((len(counts) * {Q.SQUARES} - list_sum(counts) * list_sum(counts))::double) / len(counts) else 0 end')} as std_sent_len,
 {R('coalesce(types::double / nullif(len(tokens), 0), 0)')} as ttr, {R('coalesce(mattr, 0)')} as mattr, {R('coalesce(hapax::double / nullif(types, 0), 0)')} as hapax_ratio,
 {R('coalesce(list_sum(list_transform(tokens, lambda t: length(t)))::double / nullif(len(tokens), 0), 0)')} as mean_tok_len,
 {R("coalesce((length(text) - length(replace(replace(text, ',', ''), '，', '')))::double / nullif(len(sentences), 0), 0)")} as comma_per_sent,
 {R("coalesce(len(regexp_extract_all(compact, '[.,!?;:·…" + '"' + r"''()\[\]{}—\-~]'))::double / nullif(length(compact), 0), 0)")} as punct_ratio,
 {R('coalesce(len(list_distinct(ends))::double / nullif(len(sentences), 0), 0)')} as ending_diversity, 0.0 as connective_ratio,
 {R("coalesce(len(regexp_extract_all(compact, '[0-9]'))::double / nullif(length(compact), 0), 0)")} as digit_ratio from x""",
    "a14_dominant_class": f"""with {Q.whole()}, s as (select doc_id, unnest(sentences) as s from d),
c as (select doc_id, case {' '.join(f"when regexp_matches(s, '{p}') then '{c}'" for c, p in RULES)} end as c from s),
n as (select doc_id, count(c) as n_classed, {', '.join(f"count(*) filter (where c = '{c}') as n_{c}" for c, _ in RULES)} from c group by doc_id),
b as (select *, greatest({', '.join(f'n_{c}' for c, _ in RULES)}) as top from n),
w as (select *, case {' '.join(f"when n_{c} = top then '{c}'" for c in sorted((c for c, _ in RULES), reverse=True))} end as best, top::double / nullif(n_classed, 0) as s from b)
select doc_id, n_classed, case when n_classed >= 3 and s >= 0.6 then best end as dominant, {R('s')} as share from w""",
    "a15_style_vector": rf"""with x as (select doc_id, text, list_transform(list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda s: {Q.trim('s')}), lambda s: s <> ''), lambda s: length(s)) as counts, regexp_extract_all(lower(text), '[a-z'']+') as t from documents),
y as (select *, len(t) as n from x where len(counts) >= 2 and len(t) >= 10)
select doc_id, {R('list_sum(counts)::double / len(counts) / 100')} as mean_len, {R(Q.CV)} as cv, {R('len(list_distinct(t))::double / n')} as ttr, {R("(length(text) - length(replace(text, ',', '')))::double / length(text) * 100")} as comma,
 {R("len(regexp_extract_all(text, '[;:—–]'))::double / length(text) * 100")} as marks, {R('list_sum(list_transform(t, lambda v: length(v)))::double / n / 10')} as token_len from y""",
    "a16_opener_diversity": rf"with {Q.units()}, o as (select doc_id, para_idx, list_transform(sentences, lambda s: string_split_regex({Q.trim('s')}, '\s+')[1]) as o from u) select doc_id, para_idx, {R('coalesce(len(list_distinct(o))::double / nullif(len(o), 0), 0)')} as opener_diversity from o",
    "a17_persona_features": rf"""with {Q.whole()}, {Q.mattr('u', 'doc_id, para_idx', 50)}, b as (select doc_id, avg({R(Q.CV)}) as cv from u group by doc_id), m9 as (select doc_id, avg(mattr) as mattr from m group by doc_id),
o as (select doc_id, text, len({Q.tokens('text')}) as nt, list_transform(sentences, lambda s: string_split_regex({Q.trim('s')}, '\s+')[1]) as o, (length(text) - length(replace(replace(text, ',', ''), '，', '')))::double / nullif(len(sentences), 0) as c from d)
select doc_id, {R('coalesce(b.cv, 0)', 5)} as burstiness_cv, {R('coalesce(m9.mattr, 0)', 5)} as mattr, {R('coalesce(len(list_distinct(o))::double / nullif(len(o), 0), 0)', 5)} as sentence_opener_diversity, {R('coalesce(c, 0)', 5)} as comma_per_sentence,
 0.0 as suffix_class_diversity, 0.0 as ko_register_plain_ratio, 0.0 as ko_register_polite_ratio, {R(f'({places(WORDS[0])}) * 1000.0 / greatest(nt, 1)', 5)} as lexicon_density_preferred, {R(f'({places(WORDS[1])}) * 1000.0 / greatest(nt, 1)', 5)} as lexicon_density_avoid
from o left join b using (doc_id) left join m9 using (doc_id)""",
    "a19_sentence_zoom": f"""with {Q.units()}, r as (select doc_id, para_idx, generate_subscripts(counts, 1) as i, unnest(counts) as n from u where len(counts) >= 3),
l as (select *, lag(n) over (partition by doc_id, para_idx order by i) as b from r),
g as (select *, sum(case when coalesce(abs(n - b) < 0.2 * least(n, b), false) then 0 else 1 end) over (partition by doc_id, para_idx order by i) as g from l),
k as (select doc_id, para_idx, g, min(i) as a, max(i) as b from g group by all) select doc_id, para_idx, 'P' || para_idx || '.S' || a || '-S' || b as span from k where b > a""",
    "a20_bigram_redundancy": grams(2),
    "a20_trigram_redundancy": grams(3),
    "n1_nfc": "select doc_id, md5(nfc_normalize(text)) as digest from documents",
    "n5_paragraphs": list_sql(rf"list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {Q.trim('x')}), lambda x: x <> '')"),
    "n5_lines": list_sql(rf"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: {Q.trim('x')}), lambda x: x <> '')"),
    "n6_strip_list_blocks": f"with {Q.units('paragraph')}, s as (select doc_id, string_agg(prose, chr(10) || chr(10) order by para_idx) as t from p4 where prose <> '' group by doc_id) select doc_id, md5(coalesce(t, '')) as digest from documents left join s using (doc_id)",
    "n7_sentences": list_sql(Q.sentences("text")),
    "n8_tokens": list_sql(Q.tokens("text")),
    "n9_detect_language": r"""with c as (select doc_id, len(regexp_extract_all(left(text, 12000), '[가-힯]')) as ko, len(regexp_extract_all(left(text, 12000), '[぀-ヿ]')) as ja, len(regexp_extract_all(left(text, 12000), '[一-鿿]')) as zh, len(regexp_extract_all(left(text, 12000), '[A-Za-z]')) as en, lower(source) as s from documents)
select doc_id, case when regexp_matches(s, '(^|[._/-])k[ro]([._/-]|$)|korean') then 'ko' when regexp_matches(s, '(^|[._/-])ja([._/-]|$)|japanese') then 'ja' when regexp_matches(s, '(^|[._/-])zh([._/-]|$)|chinese') then 'zh' when en >= 80 and en > 2 * (ko + ja + zh) then 'en' when ko >= 8 and ko >= ja and ko >= zh then 'ko' when ja >= 8 then 'ja' when zh >= 8 then 'zh' else 'en' end as detected from c""",
    "n11_zero_width": r"select doc_id, length(regexp_replace(text, '\s+', '', 'g')) // 4 as n_marks from documents",
    "n12_homoglyph": f"select doc_id, md5(translate(text, '{T.HOMOGLYPHS[0]}', '{T.HOMOGLYPHS[1]}')) as digest from documents",
    "n14_strip_punct": r"select doc_id, md5(regexp_replace(text, '[.,!?;:()\[\]{}" + '"' + r"''…—–\-。！？、]', '', 'g')) as digest from documents",
    "n15_repeat_sentences": rf"select doc_id, coalesce(list_sum(list_transform({PIECES}, lambda p: length(p) * case when regexp_matches(p, '[^.!?\s]') then 2 else 1 end)), 0)::bigint as n_chars2 from documents",
    "n16_text_hash": "select doc_id, 'sha256:' || sha256(text) as text_hash from documents",
    "n17_redact": f"select doc_id, md5({SECRET_SQL}) as digest from documents",
    "n18_length_bucket": "select case when n_chars <= 500 then 'short' when n_chars <= 2000 then 'medium' when n_chars <= 8000 then 'long' else 'xlong' end as bucket, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1",
    "n19_is_short": rf"select doc_id, length(regexp_replace(text, '\s+', '', 'g')) <= 200 or len(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: {Q.trim('x')} <> '')) <= 3 as is_short from documents",
    "n21_snippet": r"""with a as (select doc_id, text, regexp_extract(left(text, 301), '(?s)\A(.*[.!?])\s', 1) as b, regexp_extract(text, '(?s)\A(.*?[.!?])(?:\s|\z)', 1) as f from documents)
select doc_id, md5(case when length(text) <= 300 then text when b <> '' then b when f <> '' then f else left(text, 300) end) as digest from a""",
    "n13_upper": "select doc_id, md5(upper(replace(text, 'ß', 'ss'))) as digest from documents",
    "n20_norm_match": rf"select doc_id, md5(lower({Q.trim(r'''regexp_replace(text, '\s+', ' ', 'g')''')})) as digest from documents",
}
