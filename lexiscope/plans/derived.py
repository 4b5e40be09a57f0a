"""Queries over tables that Spark derives from the given ones: Korean texts, log deliveries, files of several formats, pages with images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.operators import curation as C
from lexiscope.operators import korean as K
from lexiscope.operators import style as S
from lexiscope.operators import verdicts as V
from lexiscope.plans import sql as Q
from lexiscope.plans.evaluation import SCORED, scored
from lexiscope.plans.verdicts import ORACLES as VERDICTS
from lexiscope.plans.verdicts import lexicon
from lexiscope.session import shared_dir, table
from lexiscope.sources import corpora as R
from lexiscope.sources import pages as P
from lexiscope.streaming import events as D

R6 = Q.r6

# --- Korean ----------------------------------------------------------------------------------

#: Sentences that a document's number picks from.
KOREAN = (
    "그는 학교에서 책을 읽는다", "나는 집에 간다", "우리는 함께 밥을 먹었습니다", "이 문제는 다음과 같다", "친구에게 편지를 보냈어요", "날씨가 좋네요", "그것은 매우 중요한 일이다", "회의를 가졌다", "연구자들은 결과를 보고한다", "시장에서 과일을 샀습니다", "데이터에 의해 결정된다", "모두가 웃었다", "바람이 분다",
)
LENGTH = (9, 7, 5)  # sentences: this many by doc_id, and steps


def korean(spark, d):
    """A Korean text for each document: up to nine sentences in one to three paragraphs, some with commas."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, KOREAN)), F.pmod(F.col("doc_id") * 7 + i * F.col("step"), F.lit(len(KOREAN))).cast("int") + 1)
    end = lambda i: F.when(F.pmod(F.col("doc_id") + i, F.lit(4)) == 0, ".\n\n").when(F.pmod(F.col("doc_id") + i, F.lit(5)) == 0, ", ").otherwise(". ")
    x = table(spark, d, "documents").withColumn("step", F.pmod("doc_id", F.lit(3)))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.pmod("doc_id", F.lit(LENGTH[0]))), lambda i: F.concat(pick(i), end(i))), "")
    return x.select("doc_id", F.lit("ko").alias("lang"), "source", text.alias("text"))


def whole(spark, d):
    return S.document_units(korean(spark, d))


_pick = f"[{', '.join(repr(s) for s in KOREAN)}][(doc_id * 7 + i * (doc_id % 3)) % {len(KOREAN)} + 1]"
KO = f"""ko as (select doc_id, 'ko' as lang, source, array_to_string(list_transform(range(0, doc_id % {LENGTH[0]} + 1), lambda i: {_pick} || case when (doc_id + i) % 4 = 0 then '.' || chr(10) || chr(10) when (doc_id + i) % 5 = 0 then ', ' else '. ' end), '') as text from documents)"""
KOW = f"{KO}, {Q.whole('ko')}"
HANGUL = "[ㄱ-ㆎ가-힣]"


def words(x: str) -> str:
    return f"list_filter({Q.tokens(x)}, lambda w: regexp_matches(w, '{HANGUL}'))"


LENS = f"list_filter(list_transform({words('text')}, lambda w: length(regexp_replace(w, '[^ㄱ-ㆎ가-힣]', '', 'g'))), lambda n: n > 0)"
SUFFIX = K.alternation(s for g in K.SUFFIXES.values() for s in g)
CLASSES = "map {" + ", ".join(f"'{w}': '{g}'" for g, ws in K.SUFFIXES.items() for w in ws) + "}"
ENDINGS = K.alternation({*K.FORMAL, *K.POLITE, *K.PLAIN})
_ko_cv = Q.CV.replace("counts", "ko_lens")
SPACING = f"""sp0 as (select *, {LENS} as ko_lens from d),
sp as (select *, len(ko_lens) as eojeols, {R6('list_sum(ko_lens)::double / nullif(len(ko_lens), 0)')} as mean_length, {R6(_ko_cv)} as length_cv, {R6('len(list_filter(ko_lens, lambda n: n = 1))::double / nullif(len(ko_lens), 0)')} as single_share, {R6('len(list_filter(ko_lens, lambda n: n >= 7))::double / nullif(len(ko_lens), 0)')} as long_share from sp0),
sf0 as (select *, list_filter(list_transform({words('text')}, lambda w: regexp_extract(w, '^.+?({SUFFIX})$', 1)), lambda s: s <> '') as sfx from sp),
sf as (select *, len(sfx) as suffixes, {R6(f'len(list_distinct(list_transform(sfx, lambda s: {CLASSES}[s])))::double / nullif(len(sfx), 0)')} as class_diversity, {R6('len(list_distinct(sfx))::double / nullif(len(sfx), 0)')} as suffix_diversity from sf0)"""


def low(x: str, top: float) -> str:
    return f"case when {x} <= {top} then (1 - {x} / {top}) * 100 else 0 end"


DIAGNOSE = f"""dg0 as (select *, len(regexp_extract_all(text, '[,，、]'))::double / nullif(len(sentences), 0) as cps from sf),
dg1 as (select *, least(coalesce({low('length_cv', 0.38)}, 0), coalesce({low('cps', 1.0)}, 0), case when suffixes >= 10 then coalesce({low('class_diversity', 0.26)}, 0) else 0 end) as weakest from dg0),
dg as (select *, len(sentences) >= 4 and eojeols >= 20 and weakest > 0 as hot from dg1)"""
LAST = f"list_transform(sentences, lambda s: {words('s')}[-1])"
_stem = "regexp_extract(w, '(.)(?:니다|니까)$', 1)"
NAMED = f"list_filter(list_transform({LAST}, lambda w: case when w is null then null when regexp_extract(w, '({ENDINGS})$', 1) in ('', '다') and regexp_matches({_stem}, '^[가-힣]$') and (unicode({_stem}) - 44032) % 28 = 17 then '{K.FUSED}' when regexp_extract(w, '({ENDINGS})$', 1) <> '' then regexp_extract(w, '({ENDINGS})$', 1) end), lambda e: e is not null)"
PLAIN = "(" + ", ".join(f"'{w}'" for w in K.PLAIN) + ")"
REGISTER = f"list_filter(list_transform({LAST}, lambda w: case when regexp_matches(w, '(?:니다|니까)$') then 'formal' when regexp_matches(w, '[요죠]$') then 'polite' when regexp_matches(w, '다$') then 'plain' end), lambda k: k is not null)"

# --- logs ------------------------------------------------------------------------------------

PER_DELIVERY = 8


def bodies(spark, d):
    """Log deliveries of eight entries: JSON arrays or lines by turns; every ninth is cut short, every eleventh has an entry without a time."""
    e = table(spark, d, "events").withColumn("delivery_id", F.floor(F.col("event_id") / PER_DELIVERY))
    field = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    channel = F.when(F.col("user_id") % 7 == 0, "staging").otherwise("production")
    outcome = F.when(F.col("event_type") == "error", "terminal_failed").when(F.col("event_type") == "purchase", "odd").otherwise("completed")
    latency = F.when(F.col("value") < 5, "<=30s").otherwise(">120s")
    parts = [("schemaVersion", F.lit("v1")), ("schema", F.lit("web.v1")), ("channel", channel), ("evidenceClass", F.lit("aggregate_only")), ("tier", F.lit("pro")), ("outcome", outcome), ("latencyBucket", latency), ("statusClass", F.lit("2xx")), ("sampling", F.lit("full"))]
    message = F.concat(F.lit("n="), F.col("event_id").cast("string"), F.lit(" {"), F.concat_ws(",", *[field(n, v) for n, v in parts]), F.lit("} end"))
    time = F.when((F.col("delivery_id") % 11 == 0) & (F.col("event_id") % PER_DELIVERY == 3), F.lit(None)).otherwise(F.lit(1704067200000) + F.col("event_id") * 1000)
    entry = F.to_json(F.struct(message.alias("message"), time.alias("timestamp")))
    g = e.select("delivery_id", "event_id", entry.alias("j")).groupBy("delivery_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "j"))), lambda x: x["j"]).alias("js"))
    body = F.when(F.col("delivery_id") % 2 == 0, F.concat(F.lit("["), F.array_join("js", ","), F.when(F.col("delivery_id") % 9 == 0, "").otherwise("]"))).otherwise(F.concat(F.array_join("js", "\n"), F.when(F.col("delivery_id") % 9 == 0, "\nnot json").otherwise("")))
    return g.select("delivery_id", body.alias("body"))


LOGS = f"""lg as (select event_id // {PER_DELIVERY} as delivery_id, event_id, user_id, event_type, value, row_number() over (partition by event_id // {PER_DELIVERY} order by event_id) - 1 as pos from events),
ok as (select delivery_id from lg group by delivery_id having delivery_id % 9 <> 0 and not (delivery_id % 11 = 0 and bool_or(event_id % {PER_DELIVERY} = 3 and event_type <> 'purchase'))),
lv as (select lg.* from lg join ok using (delivery_id) where event_type <> 'purchase')"""

# --- files -----------------------------------------------------------------------------------


def json_lines(spark, d):
    """The documents as lines of JSON, every seventh one broken, written and read back."""
    x = table(spark, d, "documents")
    path = shared_dir(spark)
    broken = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(", broken"))
    x.select(F.when(F.col("doc_id") % 7 == 0, broken).otherwise(F.to_json(F.struct("doc_id", "text"))).alias("value")).write.text(path)
    return R.read_jsonl(spark, path, "doc_id long, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("_corrupt").alias("corrupt"))


def fronted(spark, d):
    x = table(spark, d, "documents")
    head = F.concat(F.lit("---\nid: d"), F.col("doc_id").cast("string"), F.lit("\nlang: '"), F.col("lang"), F.lit("'\ntags:\n  - "), F.col("source"), F.lit("\n  - last # why\n---\n"))
    y = R.parse_front_matter(x.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat(head, F.col("text"))).alias("text")))
    meta = lambda k: F.col("meta")[k]
    return y.select("doc_id", meta("id").alias("id"), meta("lang").alias("lang"), meta("tags/0").alias("tag"), F.size("meta").alias("keys"), F.md5(F.col("body").cast("binary")).alias("digest"))


def manifest(spark, d):
    path = shared_dir(spark)
    C.write_scored(scored(spark, d).select("doc_id", "lang", "source", "text", "score", "expected"), path)
    return spark.read.parquet(path)


def streamed(spark, d):
    """Paragraph verdicts of the documents as a stream of files."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out, mark = shared_dir(spark), shared_dir(spark)
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/documents.parquet*")
    D.score_stream(stream, lexicon(spark, d), out, mark, 20).awaitTermination()
    return spark.read.parquet(out).select(*V.VERDICT)


def pictured(spark, d):
    """The pages with up to eleven images each, with and without descriptions, sizes and sources that count."""
    x = table(spark, d, "pages")
    tag = lambda i: F.concat(F.lit('<img src="'), F.when(F.pmod(F.col("page_id") + i, F.lit(5)) == 0, "/logo.png").otherwise(F.concat(F.lit("/i/"), i.cast("string"), F.lit(".png"))), F.lit('" alt="'), F.when(i % 3 == 0, "").when(i % 3 == 1, "short").otherwise("a longer description"), F.lit('" width="'), (i * 100).cast("string"), F.lit('">'))
    tags = F.array_join(F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.pmod("page_id", F.lit(12))), lambda i: i > 0), tag), "")
    return P.page_images(x.withColumn("html", F.concat(F.coalesce("html", F.lit("")), tags)))


QUERIES = {
    "a6_spacing_profile": lambda s, d: K.spacing_profile(whole(s, d)).select("doc_id", "eojeols", "mean_length", "length_cv", "single_share", "long_share"),
    "a7_suffix_profile": lambda s, d: K.suffix_profile(whole(s, d)).select("doc_id", "suffixes", "class_diversity", "suffix_diversity"),
    "a8_diagnostics": lambda s, d: K.diagnostics(whole(s, d)).select("doc_id", "diagnostic_hot", "diagnostic_strength"),
    "a9_sentence_endings": lambda s, d: (lambda u: u.select("doc_id", F.array_join(K.endings(u), ",").alias("endings")))(whole(s, d)),
    "a10_ending_monotony": lambda s, d: K.ending_monotony(whole(s, d)).select("doc_id", "plain_count", "plain_share", "ending_hot"),
    "a12_post_edit_profile": lambda s, d: K.post_edit_profile(whole(s, d), ["doc_id"]),
    "a14_register": lambda s, d: K.register(whole(s, d)),
    "r5_calques": lambda s, d: K.apply_rules(korean(s, d)).groupBy("doc_id", "rule").agg(F.count("*").alias("n")),
    "r6_translationese": lambda s, d: K.translationese(whole(s, d), korean(s, d)),
    "s1_json_lines": json_lines,
    "s5_front_matter": fronted,
    "s11_deliveries": lambda s, d: D.parse_deliveries(bodies(s, d)).select("delivery_id", "pos", F.unix_millis("ts").alias("ms"), F.length("message").alias("chars")),
    "s12_log_events": lambda s, d: D.extract_events(D.parse_deliveries(bodies(s, d))).select("delivery_id", "pos", "channel", "tier", "outcome", "latency"),
    "s16_page_images": pictured,
    "k2_scored_manifest": manifest,
    "d15_score_stream": streamed,
}

ORACLES = {
    "a6_spacing_profile": f"with {KOW}, {SPACING} select doc_id, eojeols, mean_length, length_cv, single_share, long_share from sp",
    "a7_suffix_profile": f"with {KOW}, {SPACING} select doc_id, suffixes, class_diversity, suffix_diversity from sf",
    "a8_diagnostics": f"with {KOW}, {SPACING}, {DIAGNOSE} select doc_id, hot as diagnostic_hot, case when hot then {R6('weakest', 4)} else 0 end as diagnostic_strength from dg",
    "a9_sentence_endings": f"with {KOW} select doc_id, array_to_string({NAMED}, ',') as endings from d",
    "a10_ending_monotony": f"with {KOW}, e as (select doc_id, counts, tokens, {NAMED} as e from d), p as (select doc_id, counts, tokens, len(list_filter(e, lambda v: v in {PLAIN})) as plain_count, len(e) as k from e), q as (select *, {R6('plain_count::double / nullif(k, 0)')} as plain_share from p) select doc_id, plain_count, plain_share, coalesce(len(tokens) >= 20 and {Q.CV} < 0.3 and plain_share >= 0.6 and plain_count >= 2, false) as ending_hot from q",
    "a14_register": f"with {KOW}, k as (select doc_id, {REGISTER} as k from d), n as (select doc_id, len(k) as classified, " + ", ".join(f"len(list_filter(k, lambda v: v = '{n}')) >= 0.6 * len(k) as {n}" for n in ("formal", "polite", "plain")) + " from k) select doc_id, classified, case when classified >= 3 then case when formal then 'formal' when polite then 'polite' when plain then 'plain' else 'mixed' end end as register from n",
    "s1_json_lines": "select case when doc_id % 7 <> 0 then doc_id end as doc_id, case when doc_id % 7 <> 0 then md5(text) end as digest, case when doc_id % 7 = 0 then '{\"doc_id\": ' || doc_id || ', broken' end as corrupt from documents",
    "s5_front_matter": f"select doc_id, case when doc_id % 4 <> 0 then 'd' || doc_id end as id, case when doc_id % 4 <> 0 then lang end as lang, case when doc_id % 4 <> 0 then source end as tag, case when doc_id % 4 <> 0 then 4 else 0 end as keys, md5({Q.trim('text')}) as digest from documents",
    "s11_deliveries": f"with {LOGS} select delivery_id, pos, 1704067200000 + event_id * 1000 as ms, 176 + length(event_id::varchar) + case when user_id % 7 = 0 then 7 else 10 end + case when event_type = 'error' then 15 else 9 end + 5 as chars from lv",
    "s12_log_events": f"with {LOGS} select delivery_id, pos, case when user_id % 7 = 0 then 'staging' else 'production' end as channel, 'pro' as tier, case when event_type = 'error' then 'terminal_failed' else 'completed' end as outcome, case when value < 5 then '<=30s' else '>120s' end as latency from lv",
    "s16_page_images": """with g as (select page_id, unnest(range(1, page_id % 12 + 1)) as i from pages),
x as (select page_id, i - 1 as idx, '/i/' || i || '.png' as src, case i % 3 when 0 then '' when 1 then 'short' else 'a longer description' end as alt, case i % 3 when 0 then 0 when 1 then 1 else 2 end + case when i * 100 >= 300 then 2 else 0 end as priority from g where (page_id + i) % 5 <> 0),
r as (select * from x qualify row_number() over (partition by page_id order by priority desc, idx) <= 8) select *, row_number() over (partition by page_id order by idx) as rank from r""",
    "k2_scored_manifest": f"with {SCORED} select doc_id, lang, source, score, expected from s",
    "d15_score_stream": VERDICTS["v1_paragraph_verdicts"],
}
