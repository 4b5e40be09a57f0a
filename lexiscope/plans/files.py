"""Queries over files of several formats that Spark writes from the given tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.operators import korean as K
from lexiscope.plans import derived
from lexiscope.session import delete, shared_dir, table
from lexiscope.sources import corpora as R

LANGS = ("en", "fr", "de", "es")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
S = F.lit


def put(lines, folder, name):
    """lines(at, value) in the order of `at` as one file of that name; the readers of these formats take a file as a whole."""
    spark, part = lines.sparkSession, shared_dir(lines.sparkSession)
    lines.orderBy("at").select("value").coalesce(1).write.text(part)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = path(f"{folder}/{name}")
    fs.mkdirs(target.getParent())
    made = [f.getPath() for f in fs.listStatus(path(part)) if f.getPath().getName().startswith("part-")]
    fs.rename(made[0], target)
    delete(spark, part)


def fixed(spark, start, *texts):
    """Lines that stand at `start` and after, before those of larger `at`."""
    return spark.createDataFrame([(start + i / 1000, t) for i, t in enumerate(texts)], "at double, value string")


def at(base, key, value):
    return [(S(float(base)) + F.col(key) / 1e12).alias("at"), value.alias("value")]


def genres(spark, d):
    """The documents as lines of JSON, a file for each language; a third of the labels are no labels."""
    x, folder = table(spark, d, "documents"), shared_dir(spark)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("index"), "text", (F.col("doc_id") % 3).alias("label"), F.col("source").alias("written_by")))
    for lang in LANGS:
        put(x.filter(F.col("lang") == lang).select(*at(0, "doc_id", line)), folder, f"{lang}.jsonl")
    got = R.read_genre_corpus(spark, folder)
    return got.select("index", "label", "written_by", "genre", F.array_join("errors", ",").alias("errors"), F.md5(F.col("text").cast("binary")).alias("digest"))


def tree(spark, d):
    """A file of document numbers for each language, in two folders and with three endings, one of which isn't prose; English files bear no mark."""
    x, folder = table(spark, d, "documents"), shared_dir(spark)
    for i, lang in enumerate(LANGS):
        mark = "" if lang == "en" else f".{lang}"
        for ending in ("md", "txt", "py"):
            put(x.filter(F.col("lang") == lang).select(*at(0, "doc_id", F.concat(F.col("doc_id").cast("string"), S(f" {ending}")))), folder, f"part{i % 2}/list{mark}.{ending}")
    return R.read_prose_tree(spark, folder)


def name_of(df):
    return df.select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("file"), F.md5(F.col("text").cast("binary")).alias("digest"))


def lexicons(spark, d):
    """A lexicon for each language, with words and phrases drawn from its documents, and lines that are no entries."""
    x, folder = table(spark, d, "documents"), shared_dir(spark)
    for lang in LANGS:
        own = x.filter(F.col("lang") == lang)
        words = own.select((F.col("doc_id") % 97).alias("k")).distinct().select(*at(2, "k", F.concat(S("- word"), F.col("k").cast("string"), S("  "))))
        phrases = own.select((F.col("doc_id") % 13).alias("k")).distinct().select(*at(4, "k", F.concat(S("- of ~ "), F.col("k").cast("string"))))
        more = fixed(spark, 1, f"# {lang}", "- not this", "## Strict matches (all)"), fixed(spark, 3, "", "## Multi-word phrases"), fixed(spark, 5, "## Notes", "- nor this")
        put(words.unionByName(phrases).unionByName(more[0]).unionByName(more[1]).unionByName(more[2]), folder, f"ai-{lang}.md")
    return R.read_lexicon(spark, folder, 3)


def places(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", "n_name", "r_name")


def packs(spark, d):
    """A pattern pack for each region with a section for each of its nations."""
    x, folder = places(spark, d), shared_dir(spark)
    for r in REGIONS:
        own = x.filter(F.col("r_name") == r)
        k = F.col("n_nationkey").cast("string")
        section = F.concat(S("### "), k, S(". "), F.col("n_name"), S("\n\n**Watch words:** "), F.lower("n_name"), S(", \"term"), k, S("\", term"), k, S("\n\nmore\n"))
        head = fixed(spark, 0, "---", f"pack: en-{r[:4].lower().strip()}", "language: en", "---", "# Title", "")
        put(own.select(*at(1, "n_nationkey", section)).unionByName(head), folder, f"{r[:4].strip()}.md")
    return R.read_patterns(spark, folder)


def policies(spark, d):
    """A policy for each region that names its nations; every second one lacks its purpose."""
    x, folder = places(spark, d), shared_dir(spark)
    for i, r in enumerate(REGIONS):
        action = F.element_at(F.array(*[S(a) for a in R.POLICY_ACTIONS]), (F.col("n_nationkey") % 3 + 1).cast("int"))
        rows = x.filter(F.col("r_name") == r).select(*at(1, "n_nationkey", F.concat(S("    "), F.col("n_nationkey").cast("string"), S(": "), action)))
        head = ["---", f"document-type: type{i}", "name: n", "version: 1", "scope: s", *([] if i % 2 else ["purpose: p"]), *[f"{k}: [v]" for k in R.POLICY_LISTS], "pattern-overrides:", "  en:"]
        put(rows.unionByName(fixed(spark, 0, *head)).unionByName(fixed(spark, 2, "---", "Body")), folder, f"type{i}.md")
    return R.read_policies(spark, folder)


def personas(spark, d):
    """A persona for each region whose words and targets are its nations."""
    x, folder = places(spark, d), shared_dir(spark)
    for i, r in enumerate(REGIONS):
        own, k = x.filter(F.col("r_name") == r), F.col("n_nationkey").cast("string")
        words = own.select(*at(1, "n_nationkey", F.concat(S("      - "), F.lower("n_name"))))
        targets = own.select(*at(3, "n_nationkey", F.concat(S("  f"), k, S(":\n    target: "), k, S(".5\n    weight: 2"))))
        head = fixed(spark, 0, "---", f"id: p{i}", f"lang: {'en' if i < 4 else 'xx'}", "blocks:", "  preferred_words:", "    allow:")
        put(words.unionByName(targets).unionByName(head).unionByName(fixed(spark, 2, "    avoid: [a, 'b']", "target_features:")).unionByName(fixed(spark, 4, "---", "Body")), folder, f"p{i}.md")
    return R.read_personas(spark, folder)


def segments(spark, d):
    """The customers as translation units; every third has no target, every fourth is locked."""
    x, folder = table(spark, d, "customer"), shared_dir(spark)
    k = F.col("c_custkey")
    unit = F.concat(
        S('<trans-unit id="'), k.cast("string"), S('" resname="'), F.col("c_name"), S('"'), F.when(k % 4 == 0, ' locked="yes"').otherwise(""), S("><source>"), F.col("c_name"), S("</source>"),
        F.when(k % 3 == 0, "").otherwise(F.concat(S('<target state="final">to '), F.col("c_name"), S("</target>"))), S("</trans-unit>"),
    )
    put(x.select(*at(1, "c_custkey", unit)).unionByName(fixed(spark, 0, "<xliff><file><body>")).unionByName(fixed(spark, 2, "</body></file></xliff>")), folder, "a.xliff")
    return R.read_segments(spark, f"{folder}/a.xliff").select("id", "resname", "translate", "locked", "approved", "source", "target", "state")


def detectors(spark, d):
    """The labels as a detector's reports, eight files, with words for verdicts that it may and may not use."""
    x, folder = table(spark, d, "labels"), shared_dir(spark)
    word = F.element_at(F.array(S("AI"), S(" human "), S("maybe"), S("Machine")), (F.col("doc_id") % 4 + 1).cast("int"))
    row = F.struct(F.col("doc_id").cast("string").alias("fixture_id"), S("d").alias("detector"), word.alias("label"), F.when(F.col("doc_id") % 5 == 0, F.col("toxic") == 1).alias("predicted_hot"), (F.col("doc_id") % 10 / 10.0).alias("score"))
    files = x.groupBy((F.col("doc_id") % 8).alias("file")).agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("value"))
    files.repartition("file").write.partitionBy("file").text(folder)
    return R.read_detector_labels(spark, folder)


QUERIES = {
    "a5_eojeols": lambda s, d: derived.korean(s, d).select("doc_id", F.array_join(K.eojeols("text"), " ").alias("eojeols"), F.array_join(K.lengths(K.eojeols("text")), ",").alias("lengths")),
    "s2_genre_corpus": genres,
    "s3_prose_tree": lambda s, d: name_of(tree(s, d)),
    "s4_lang_files": lambda s, d: name_of(R.select_lang_files(tree(s, d), "en")).unionByName(name_of(R.select_lang_files(tree(s, d), "fr"))),
    "s6_lexicon": lexicons,
    "s7_patterns": lambda s, d: (lambda p: p[0].join(p[1].groupBy("pattern_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms")), "pattern_id"))(packs(s, d)),
    "s8_policies": lambda s, d: (lambda p: p[1].join(p[0].select("document_type", F.array_join("errors", ",").alias("errors")), "document_type"))(policies(s, d)),
    "s9_personas": lambda s, d: (lambda p: p[1].join(p[0].select("persona_id", F.array_join("allow", ",").alias("allow"), F.array_join("avoid", ",").alias("avoid"), F.array_join("errors", ",").alias("errors")), "persona_id"))(personas(s, d)),
    "s10_segments": segments,
    "s13_detector_labels": detectors,
}

_words = derived.words("text")
LISTS = "\n union all ".join(
    f"select 'part{i % 2}/list{'' if g == 'en' else '.' + g}.{e}' as file, '{g}' as lang, md5(string_agg(doc_id || ' {e}', chr(10) order by doc_id) || chr(10)) as digest from documents where lang = '{g}'"
    for i, g in enumerate(LANGS) for e in ("md", "txt")
)
PLACE = f"pl as (select n_nationkey as k, n_name, r_name, list_position([{', '.join(repr(r) for r in REGIONS)}], r_name) - 1 as i from nation join region on n_regionkey = r_regionkey)"
ORACLES = {
    "a5_eojeols": f"with {derived.KO}, e as (select doc_id, {_words} as w from ko) select doc_id, array_to_string(w, ' ') as eojeols, array_to_string(list_filter(list_transform(w, lambda x: length(regexp_replace(x, '[^ㄱ-ㆎ가-힣]', '', 'g'))), lambda n: n > 0), ',') as lengths from e",
    "s2_genre_corpus": f"select doc_id::varchar as index, doc_id % 3 as label, source as written_by, lang as genre, concat_ws(',', case when doc_id % 3 = 2 then 'label' end, case when {derived.Q.trim('text')} = '' then 'text' end) as errors, md5(text) as digest from documents where lang in {LANGS}",
    "s3_prose_tree": f"with f as ({LISTS}) select file, digest from f",
    "s4_lang_files": f"with f as ({LISTS}) select file, digest from f where lang in ('en', 'fr')",
    "s6_lexicon": f"select distinct lang, 'strict' as kind, 'word' || doc_id % 97 as entry, 3 as priority from documents where lang in {LANGS} union all select distinct lang, 'phrase', 'of ~ ' || doc_id % 13, 3 from documents where lang in {LANGS}",
    "s7_patterns": f"with {PLACE}, c as (select *, trim(lower(r_name[:4])) as g from pl) select 'en-' || g || ':' || k as pattern_id, 'en' as lang, 'en-' || g as pack, g as category, k as number, n_name as title, array_to_string(list_sort([lower(n_name), 'term' || k]), ',') as terms from c",
    "s8_policies": f"with {PLACE} select 'type' || i as document_type, 'en' as lang, k as pattern_no, ['suppress', 'reduce', 'amplify'][k % 3 + 1] as action, case when i % 2 = 1 then 'purpose' else '' end as errors from pl",
    "s9_personas": f"with {PLACE}, a as (select i, array_to_string(list(lower(n_name) order by k), ',') as allow from pl group by i) select 'p' || i as persona_id, case when i < 4 then 'en' else 'xx' end as lang, 'f' || k as feature, k + 0.5 as target, cast(null as double) as tolerance, 2.0 as weight, cast(null as double) as max, allow, 'a,b' as avoid, case when i < 4 then '' else 'lang' end as errors from pl join a using (i)",
    "s10_segments": "select c_custkey::varchar as id, c_name as resname, cast(null as varchar) as translate, case when c_custkey % 4 = 0 then 'yes' end as locked, cast(null as varchar) as approved, c_name as source, case when c_custkey % 3 <> 0 then 'to ' || c_name end as target, case when c_custkey % 3 <> 0 then 'final' end as state from customer",
    "s13_detector_labels": "select doc_id::varchar as fixture_id, 'd' as detector, case when doc_id % 5 = 0 then toxic = 1 when doc_id % 4 = 1 then false when doc_id % 4 <> 2 then true end as predicted, doc_id % 10 / 10.0 as score from labels",
}
