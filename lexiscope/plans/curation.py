"""Queries of curation, pages, takes and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators import curation as C
from lexiscope.operators import rules as R
from lexiscope.plans import sql as Q
from lexiscope.plans.evaluation import SCORED, scored
from lexiscope.session import table
from lexiscope.sources import pages as P

LICENCES = ["CC0", "private", " cc-by ", "hash-only", "unknown"]


def docs(spark, d):
    return table(spark, d, "documents")


def licensed(spark, d):
    """Documents with a licence by their number, and a few blank texts."""
    lic = F.element_at(F.array(*[F.lit(x) for x in LICENCES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs(spark, d).withColumns({"redistribution": lic, "text": F.when(F.col("doc_id") % 17 == 0, F.lit(" ")).otherwise(F.col("text"))})


def manifest(spark, d):
    x = licensed(spark, d)
    return x.select(
        F.concat(F.lit(" s"), F.col("doc_id")).alias("sample_id"), "doc_id", F.upper("lang").alias("language"), F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 2 == 0, "human").otherwise("AI-like").alias("class"), F.col("source").alias("register"),
        F.concat(F.lit("f"), F.col("doc_id") % 4).alias("model_family"), F.when(F.col("doc_id") % 13 == 0, "soon").otherwise("2025-01-02").alias("generated_at"), "redistribution", "text", F.when(F.col("doc_id") % 3 == 0, F.lit("sha256:xyz")).otherwise(T.text_hash("text")).alias("text_hash"),
    )


def checked(spark, d):
    return C.validate_manifest(manifest(spark, d), ("human", "ai-like"), tuple(f"src{i}" for i in range(18)), ("f0", "f1", "f2"))


def segments(spark, d):
    conv = table(spark, d, "conversations")
    t = F.when(F.col("turn") % 5 == 0, F.lit("")).when(F.col("turn") % 5 == 1, F.concat(F.lit("<b>"), F.col("text"))).when(F.col("turn") % 5 == 2, F.lit("one two")).otherwise(F.col("text"))
    return conv.select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, "no").alias("translate"), F.lit(None).cast("string").alias("locked"), F.lit("yes").alias("approved"), F.when(F.col("conv_id") % 5 == 0, "new").otherwise("final").alias("state"), F.when(F.col("turn") % 5 == 3, F.col("text")).otherwise(F.lit("x")).alias("source"), t.alias("target"))


def aliases(spark, d):
    """Source names onto the region of the same number, a lookup table from the data."""
    return table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("alias"), F.lower("n_name").alias("canonical"))


def langs(spark, d):
    a = docs(spark, d).select(F.col("lang").alias("alias")).distinct().filter("alias <> 'es'").withColumn("canonical", F.col("alias"))
    tag = F.concat("lang", F.element_at(F.array(F.lit(""), F.lit("-XX"), F.lit("_yy")), (F.col("doc_id") % 3 + 1).cast("int")))
    return C.normalize_lang(docs(spark, d).select("doc_id", F.upper(tag).alias("tag")), a, "tag")


def entries(spark, d):
    """A lexicon and its provenance: customers and the orders that name them."""
    lex = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 400).alias("entry"), F.lit("en").alias("lang")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey")).alias("entry"), F.lit("en").alias("lang")))
    prov = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("c"), F.col("o_custkey") % 700).alias("entry"), F.lit("en").alias("lang"))
    return lex, prov


def patterns(spark, d):
    """Marks in documents as pattern hits."""
    marks = [("dash", "-"), ("pipe", "|"), ("star", "*"), ("bang", "!"), ("at", "@"), ("digit", "7")]
    cells = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(m)), F.lit(n)) for n, m in marks]))
    return docs(spark, d).select("lang", "doc_id", F.explode(cells).alias("pattern"))


def overlap(spark, d):
    known = docs(spark, d).filter("doc_id = 0").select(F.lit("bang").alias("a"), F.lit("dash").alias("b"))
    return C.pattern_overlap(patterns(spark, d), known)


def public(spark, d):
    a, b = C.split_public_private(licensed(spark, d))
    side = lambda x, n: x.agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.count_distinct("text_hash").alias("hashes")).withColumn("side", F.lit(n))
    return side(a, "public").unionByName(side(b, "private"))


def paragraphs(spark, d):
    return P.html_to_paragraphs(table(spark, d, "pages"), "en", 40)


def lines_of_pages(spark, d):
    return P.html_to_paragraphs(table(spark, d, "pages"), None)


def quota(spark, d):
    return C.quota_sample(docs(spark, d).select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("register")), 5, 20).select("id", "source", "register")


def priority(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("priority"))
    return C.priority_topk(e, "user_id", "priority", "event_id", 3).select("user_id", "event_id", "priority", "rank")


def ids(spark, d):
    old = docs(spark, d).filter("doc_id % 10 = 0").select("lang", (F.col("doc_id") % 40).alias("number"))
    return C.assign_ids(docs(spark, d).filter("doc_id % 10 <> 0").select("doc_id", "lang"), old, "lang", "doc_id")


def study(spark, d):
    x = docs(spark, d).select("doc_id", F.col("lang").alias("register"), F.floor(F.col("doc_id") / 2).alias("prompt_id"))
    return C.study_sample(x.filter("doc_id % 2 = 0 and doc_id % 6 <> 4"), x.filter("doc_id % 2 = 1 and doc_id % 5 <> 0"), 12, "register", "doc_id")


def bags(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    return C.bags_equal(x.filter("l_linenumber % 2 = 0"), x.filter("l_linenumber % 2 = 1"), ["l_orderkey"], "l_returnflag")


def hashed(spark, d):
    return docs(spark, d).select("doc_id", "lang", "source", T.text_hash("text").alias("text_hash"))


def runs(spark, d):
    x = hashed(spark, d).dropDuplicates(["text_hash"]).select("text_hash", F.char_length("text_hash").alias("v"))
    return C.join_runs(x.filter(F.col("text_hash") < "sha256:c"), x.filter(F.col("text_hash") > "sha256:3"), x.filter(F.col("text_hash") > "sha256:8"), "text_hash")


QUERIES = {
    "f1_useful_paragraph": lambda s, d: lines_of_pages(s, d).select("page_id", "idx", C.useful_paragraph("text", "en", 40, 700).alias("useful")),
    "f2_prose_like": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", C.prose_like("text").alias("prose")),
    "f3_classify_segments": lambda s, d: C.classify_segments(segments(s, d)).groupBy(F.coalesce("reason", F.lit("-")).alias("reason"), "select").agg(F.count("*").alias("n")),
    "f4_can_redistribute": lambda s, d: licensed(s, d).select("doc_id", C.can_redistribute("redistribution").alias("ok")),
    "f5_select_fixture_rows": lambda s, d: C.select_fixture_rows(scored(s, d).join(licensed(s, d).select("doc_id", "redistribution"), "doc_id")).groupBy("route").agg(F.count("*").alias("n")),
    "f7_clean_messages": lambda s, d: C.clean_messages(docs(s, d).select("doc_id", F.explode(T.split_lines("text")).alias("text"))).groupBy("doc_id").agg(F.count("*").alias("n")),
    "f8_validate_manifest": lambda s, d: checked(s, d).select("doc_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), F.array_join("errors", ";").alias("errors")),
    "j1_canonicalize": lambda s, d: C.canonicalize(docs(s, d).select("doc_id", "source"), aliases(s, d), "source"),
    "j3_audit_provenance": lambda s, d: C.audit_provenance(*entries(s, d), ["entry", "lang"]),
    "j5_attach_text": lambda s, d: C.attach_text(table(s, d, "labels"), licensed(s, d), "doc_id").select("doc_id", "quality", F.char_length("text").alias("chars")),
    "j6_join_runs": runs,
    "j7_cooccurrence": lambda s, d: C.cooccurrence(patterns(s, d)),
    "j8_coverage": lambda s, d: C.coverage(docs(s, d), {"lang": ["en", "de", "fr", "ko"], "source": ["src0", "src1", "src99"]}, 25),
    "j9_unseen_keys": lambda s, d: C.unseen_keys(docs(s, d).select("doc_id", "lang", "text"), docs(s, d).filter("doc_id % 3 = 0").select("lang", "text"), ["lang", "text"]).select("doc_id"),
    "j10_pair_by_id": lambda s, d: C.pair_by_id(docs(s, d).filter("doc_id % 2 = 0"), docs(s, d).filter("doc_id % 3 = 0"), "doc_id", "n_chars"),
    "j11_not_exported": lambda s, d: C.not_exported(hashed(s, d), hashed(s, d).filter("doc_id % 50 = 0")).select("doc_id"),
    "j12_exclude_seen": lambda s, d: C.exclude_seen(hashed(s, d).withColumn("url", F.concat("source", F.lit("/"), F.col("doc_id") % 30)), [hashed(s, d).filter("doc_id % 7 = 0")], [docs(s, d).filter("doc_id % 12 = 0").select(F.concat("source", F.lit("/"), F.col("doc_id") % 30).alias("url"))]).select("doc_id"),
    "n10_normalize_lang": langs,
    "q4_pattern_overlap": overlap,
    "k1_split_public_private": public,
    "k3_clean_rows": lambda s, d: checked(s, d).groupBy((F.size("errors") == 0).alias("clean")).agg(F.count("*").alias("n")),
    "k4_report_cells": lambda s, d: C.report_tables(scored(s, d))["cells"],
    "s14_html_to_paragraphs": lambda s, d: paragraphs(s, d).select("page_id", "idx", F.md5(F.col("text").cast("binary")).alias("digest")),
    "s15_html_prose_blocks": lambda s, d: P.html_prose_blocks(table(s, d, "pages")).select("page_id", "idx", "tag", F.char_length("text").alias("chars"), "rank"),
    "s17_pages_to_documents": lambda s, d: P.pages_to_documents(docs(s, d).select(F.col("doc_id").alias("page_id"), F.posexplode(T.split_paragraphs("text", "line")).alias("idx", "text")), 1500, 300, 3).select("page_id", "n", F.char_length("text").alias("chars")),
    "w1_balanced_take": lambda s, d: C.balanced_take(docs(s, d).select("doc_id", "lang"), 50, "lang", ["doc_id"]),
    "w2_quota_sample": quota,
    "w3_dedup_first": lambda s, d: C.dedup_first(docs(s, d).select("doc_id", "lang", "text"), F.lower("text"), ["doc_id"]).select("doc_id", "lang"),
    "w4_priority_topk": priority,
    "w5_top_suspects": lambda s, d: C.top_suspects(scored(s, d), 25).select("doc_id", "score"),
    "w5_suspect_summary": lambda s, d: C.suspect_summary(scored(s, d)),
    "w6_trim_context": lambda s, d: C.trim_context(table(s, d, "conversations"), 6, 1500).select("conv_id", "turn"),
    "w7_assign_ids": ids,
    "w8_sample_hits": lambda s, d: docs(s, d).select("doc_id", F.array_join(R.sample_hits(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), 3), ",").alias("hits")),
    "w9_systematic_sample": lambda s, d: C.systematic_sample(table(s, d, "events").select("event_id", "user_id"), 20, F.floor(F.col("event_id") / 1000), ["event_id"]),
    "w11_study_sample": study,
    "w12_blind_sheet": lambda s, d: C.blind_sheet(docs(s, d).select("source", "lang", "n_chars"), "source", "lang", 15, 4)[1],
    "w13_hash_subset": lambda s, d: C.hash_subset(hashed(s, d), 5, "lang"),
    "u1_union_corpora": lambda s, d: C.union_corpora(docs(s, d).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), docs(s, d).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), "lang"))[1],
    "u2_set_sizes": lambda s, d: C.set_sizes(table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k"),
    "u3_set_diff": lambda s, d: docs(s, d).select("doc_id", F.size(C.set_diff(F.split(F.lower("text"), " "), F.split("text", " "))).alias("n")),
    "u4_bags_equal": bags,
}

LIC = "case doc_id % 5 when 0 then 'CC0' when 1 then 'private' when 2 then ' cc-by ' when 3 then 'hash-only' else 'unknown' end"
OK = f"lower(trim({LIC})) in ('repo-ok', 'redistributable', 'public', 'public-domain', 'cc0', 'cc-by')"
TEXT = "case when doc_id % 17 = 0 then ' ' else text end"
MARKS = [("dash", "-"), ("pipe", "|"), ("star", "*"), ("bang", "!"), ("at", "@"), ("digit", "7")]
PAT = "pt as (" + " union all ".join(f"select lang, doc_id, '{n}' as pattern from documents where contains(text, '{m}')" for n, m in MARKS) + "), co as (select lang, a.pattern as a, b.pattern as b, count(*) as n from pt a join pt b using (lang, doc_id) where a.pattern < b.pattern group by all)"
SEG = """sg as (select conv_id, turn, case when conv_id % 7 = 0 then 'no' end as translate, case when conv_id % 5 = 0 then 'new' else 'final' end as state, case when turn % 5 = 3 then text else 'x' end as source,
  case turn % 5 when 0 then '' when 1 then '<b>' || text when 2 then 'one two' else text end as target from conversations)"""
PROSE = lambda x: rf"(regexp_matches({Q.trim(x)}, '[A-Za-z]') and not regexp_matches({Q.trim(x)}, '(?i)^(https?://|mailto:)') and not regexp_matches({Q.trim(x)}, '^[^\s@]+@[^\s@]+\.[^\s@]+$') and len(string_split_regex({Q.trim(rf'''regexp_replace({Q.trim(x)}, '%[0-9]*\$?[a-zA-Z]|%\{{[^}}]*\}}|\{{\d+\}}|\{{[a-zA-Z_][A-Za-z0-9_]*\}}|<[^>]+>', ' ', 'g')''')}, '\s+')) >= 5)"
HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g'), '(?i)<(?:p|div|section|article|main|br|li|h[1-6]|tr|td|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"""
for _e, _v in P.ENTITIES:
    HTML = f"replace({HTML}, '{_e}', '{_v.replace(chr(39), chr(39) * 2)}')"
SPACES = r"regexp_replace(x, '[\s" + "  " + r"]+', ' ', 'g')"
PAGES = rf"""h0 as (select page_id, list_filter(list_transform(string_split_regex({HTML}, '\n+'), lambda x: trim({SPACES})), lambda x: x <> '') as l from pages),
h1 as (select page_id, generate_subscripts(l, 1) - 1 as idx, unnest(l) as text from h0)"""
USEFUL = rf"(length(text) between 40 and 700 and not regexp_matches(text, '{C.BOILERPLATE}') and len(regexp_extract_all(text, '[A-Za-z]')) >= 40 and len(regexp_extract_all(text, '[A-Za-z]')) >= 0.5 * greatest(len(regexp_extract_all(text, '[\pL\pN]')), 1) and not regexp_matches(text, '(?i)https?://') and len(regexp_extract_all(text, '[|{{}}\[\]<>]')) <= 5)"
FIRST = "qualify row_number() over (partition by page_id, lower(text) order by idx) = 1"

ORACLES = {
    "f1_useful_paragraph": f"with {PAGES}, f as (select * from h1 {FIRST}) select page_id, idx, {USEFUL} as useful from f",
    "f2_prose_like": f"select conv_id, turn, {PROSE('text')} as prose from conversations",
    "f3_classify_segments": f"with {SEG}, r as (select case when translate = 'no' then 'locked' when state <> 'final' then 'state_not_allowlisted' when regexp_matches(target, '<[A-Za-z/]') then 'inline_markup' when {Q.trim('target')} = '' then 'empty_target' when {Q.trim('target')} = {Q.trim('source')} then 'untranslated' when not {PROSE('target')} then 'not_prose' else '-' end as reason from sg) select reason, reason = '-' as select, count(*) as n from r group by 1",
    "f4_can_redistribute": f"select doc_id, {OK} as ok from documents",
    "f5_select_fixture_rows": f"with {SCORED}, x as (select case when trim(coalesce(text, '')) = '' then 'errors' when not {OK} then 'refused' when not expected and predicted then 'selected' else 'skipped' end as route from s) select route, count(*) as n from x group by 1",
    "f7_clean_messages": rf"with l as (select doc_id, {Q.trim('x')} as t from (select doc_id, unnest(string_split_regex(text, '\r?\n')) as x from documents)) select doc_id, count(*) as n from l where length(t) >= 4 and not regexp_matches(t, 'https?://|www\.') and not starts_with(t, '@') and not starts_with(t, '[20') group by doc_id",
    "f8_validate_manifest": f"""with m as (select doc_id, lower(lang) as language, case when doc_id % 9 = 0 then '' when doc_id % 2 = 0 then 'human' else 'ai-like' end as class, source as register, doc_id % 4 as fam, doc_id % 13 = 0 as late, {LIC} as lic, {OK} as ok, trim({TEXT}) <> '' as has, doc_id % 3 = 0 as badhash from documents),
e as (select doc_id, list_filter([case when class = '' then 'missing required field: class' end, case when language not in ('ko', 'en', 'zh', 'ja') then 'language is unknown' end, case when not regexp_matches(register, '^src([0-9]|1[0-7])$') then 'register is unknown' end, case when late then 'generated_at is no time' end, case when has and not ok then 'text may not be passed on' end, case when badhash then 'text_hash is malformed' end, case when has and badhash then 'text_hash differs' end], lambda x: x is not null) as e, (fam = 3)::int + (trim(lower(lic)) = 'unknown')::int as n_warnings from m)
select doc_id, len(e) as n_errors, n_warnings, array_to_string(e, ';') as errors from e""",
    "j1_canonicalize": "select doc_id, coalesce(lower(n_name), source) as source from documents left join nation on source = 'src' || n_nationkey",
    "j3_audit_provenance": "with l as (select 'c' || (c_custkey % 400) as entry from customer union all select 'c' || s_suppkey from supplier), p as (select 'c' || (o_custkey % 700) as entry from orders where o_orderkey % 3 = 0) select entry, 'en' as lang, problem from (select distinct entry, 'no-provenance' as problem from l where entry not in (select entry from p) union all select distinct entry, 'orphan' from p where entry not in (select entry from l) union all select entry, 'duplicate-entry' from l group by entry having count(*) > 1 union all select entry, 'duplicate-provenance' from p group by entry having count(*) > 1)",
    "j5_attach_text": f"select doc_id, quality, length({TEXT}) as chars from labels join documents using (doc_id) where trim({TEXT}) <> ''",
    "j6_join_runs": "with x as (select distinct 'sha256:' || sha256(text) as text_hash, 71 as v from documents) select a.text_hash, a.v as v_1, b.v as v_2, c.v as v_3 from (select * from x where text_hash < 'sha256:c') a join (select * from x where text_hash > 'sha256:3') b using (text_hash) left join (select * from x where text_hash > 'sha256:8') c using (text_hash)",
    "j7_cooccurrence": f"with {PAT} select * from co",
    "j8_coverage": "with g as (select * from (select unnest(['en', 'de', 'fr', 'ko']) as lang) cross join (select unnest(['src0', 'src1', 'src99']) as source)), c as (select lang, source, count(*) as n from documents group by all) select lang, source, coalesce(n, 0) as n, greatest(0, 25 - coalesce(n, 0)) as missing from g left join c using (lang, source)",
    "j9_unseen_keys": "select doc_id from documents d where not exists (select 1 from documents e where e.doc_id % 3 = 0 and e.lang = d.lang and e.text = d.text)",
    "j10_pair_by_id": "select doc_id, n_chars as before, n_chars as after from documents where doc_id % 6 = 0",
    "j11_not_exported": "select doc_id from documents d where text not in (select text from documents where doc_id % 50 = 0) and source not in (select source from documents where doc_id % 50 = 0)",
    "j12_exclude_seen": "select doc_id from documents where text not in (select text from documents where doc_id % 7 = 0) and source || '/' || (doc_id % 30) not in (select source || '/' || (doc_id % 30) from documents where doc_id % 12 = 0)",
    "n10_normalize_lang": "select doc_id, case when lang = 'es' then null else lang end as tag from documents",
    "q4_pattern_overlap": f"with {PAT}, s as (select lang, pattern, count(*) as k from pt group by all), x as (select co.*, s.k as ka, t.k as kb, n::double / (s.k + t.k - n) as j from co join s on co.lang = s.lang and co.a = s.pattern join s t on co.lang = t.lang and co.b = t.pattern) select lang, a, b, n, {Q.r6('j')} as jaccard, {Q.r6('n::double / least(ka, kb)')} as overlap, case when j < 0.3 then 'below' when a = 'bang' and b = 'dash' then 'documented' else 'undocumented' end as status from x",
    "k1_split_public_private": f"with x as (select {TEXT} as text, {OK} as ok from documents) select 'public' as side, count(*) as n, count(case when ok then text end) as texts, count(distinct text) as hashes from x union all select 'private', count(*), count(text), count(distinct text) from x where not ok",
    "k4_report_cells": f"with {SCORED} select lang, source, count(*) as n from s group by all",
    "s14_html_to_paragraphs": f"with {PAGES}, u as (select * from h1 where {USEFUL}) select page_id, idx, md5(text) as digest from u {FIRST}",
    "s17_pages_to_documents": rf"with a as (select doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: {Q.trim('x')}), lambda x: x <> '') as l from documents), b as (select doc_id, generate_subscripts(l, 1) as idx, unnest(l) as text from a), c as (select *, sum(length(text) + 2) over (partition by doc_id order by idx) - 2 as upto from b) select doc_id as page_id, count(*) as n, max(upto)::bigint as chars from c where upto <= 1500 group by doc_id having count(*) >= 3 and max(upto) >= 300",
    "w1_balanced_take": "with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn from documents) select doc_id, lang from r order by rn, lang limit 50",
    "w2_quota_sample": "with f as (select min(doc_id) as id from documents group by text), a as (select id, source, lang, row_number() over (partition by source order by id) as rn from f join documents on id = doc_id), b as (select *, row_number() over (partition by lang order by id) as rr from a where rn <= 5) select id, source, lang as register from b where rr <= 20",
    "w3_dedup_first": "select doc_id, lang from documents qualify row_number() over (partition by lower(text) order by doc_id) = 1",
    "w4_priority_topk": "with a as (select user_id, event_id, floor(value)::bigint as priority from events qualify row_number() over (partition by user_id order by floor(value) desc, event_id) <= 3) select *, row_number() over (partition by user_id order by event_id) as rank from a",
    "w5_top_suspects": f"with {SCORED} select doc_id, score from s order by score desc, doc_id limit 25",
    "w5_suspect_summary": f"with {SCORED} select count(*) as n, {Q.r6('avg(score)', 4)} as mean, count(*) filter (where score > 50) as over_50, count(*) filter (where score = 0) as at_0 from s",
    "w6_trim_context": "with x as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as n, sum(octet_length(encode(coalesce(text, '')))) over (partition by conv_id order by turn desc rows unbounded preceding) as b from conversations) select conv_id, turn from x where n <= 6 and b <= 1500",
    "w7_assign_ids": "with t as (select lang, max(doc_id % 40) as m from documents where doc_id % 10 = 0 group by lang) select doc_id, lang, coalesce(m, 0) + row_number() over (partition by lang order by doc_id) as number from documents left join t using (lang) where doc_id % 10 <> 0",
    "w8_sample_hits": "with a as (select doc_id, regexp_extract_all(text, '[0-9]+') as h from documents), b as (select doc_id, h, list_filter(range(1, len(h) + 1), lambda i: list_position(h, h[i]) = i) as f from a) select doc_id, array_to_string(list_transform(f[1:3], lambda i: h[i]), ',') as hits from b",
    "w9_systematic_sample": "select event_id, user_id from events qualify row_number() over (order by event_id) % 20 = 0",
    "w11_study_sample": "with x as (select doc_id, lang as register, doc_id // 2 as prompt_id from documents), hu as (select * from x where doc_id % 2 = 0 and doc_id % 6 <> 4), ma as (select * from x where doc_id % 2 = 1 and doc_id % 5 <> 0), r as (select *, row_number() over (partition by register order by doc_id) as rn from hu), h as (select doc_id, register, prompt_id from r order by rn, register limit 12) select *, 'human' as side from h union all select *, 'paired' from ma where prompt_id in (select prompt_id from h) union all select *, 'control' from ma where prompt_id not in (select prompt_id from h) and register in (select register from h where prompt_id not in (select prompt_id from ma))",
    "w13_hash_subset": "with h as (select doc_id, lang, source, 'sha256:' || sha256(text) as text_hash from documents) select * from h qualify row_number() over (partition by lang order by text_hash, doc_id) <= 5",
    "u1_union_corpora": "select doc_id as id, 2 as n from documents where doc_id % 6 = 0",
    "u2_set_sizes": "with a as (select distinct o_custkey as k from orders), b as (select distinct c_custkey as k from customer where c_custkey % 2 = 0) select (select count(*) from a) as a, (select count(*) from b) as b, (select count(*) from a join b using (k)) as shared, (select count(*) from (select k from a union select k from b)) as union",
    "u3_set_diff": "select doc_id, len(list_filter(list_distinct(string_split(lower(text), ' ')), lambda x: not list_contains(string_split(text, ' '), x))) as n from documents",
    "u4_bags_equal": "with n as (select l_orderkey, l_returnflag, sum(case when l_linenumber % 2 = 0 then 1 else -1 end) as n from lineitem group by all) select l_orderkey, count(*) filter (where n <> 0) = 0 as equal from n group by l_orderkey",
}
