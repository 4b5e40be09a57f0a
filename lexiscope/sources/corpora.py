"""Readers of labelled corpora, prose trees, lexicons, pattern packs, policies, personas and bilingual segments."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiscope.functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, numbered: bool = False) -> DataFrame:
    """Rows of the schema, with `_corrupt` holding lines that don't parse. With numbered=True also path and line_no; then each file is read whole, so it is for files of moderate size."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*kind.fields, StructField("_corrupt", StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if not numbered:
        return spark.read.schema(full).options(**opts).json(path)
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n", -1)).alias("i", "line"))
    return lines.filter(T.trim("line") != "").select("path", (F.col("i") + 1).alias("line_no"), F.from_json("line", full, opts).alias("r")).select("path", "line_no", "r.*")


def read_genre_corpus(spark: SparkSession, path: str) -> DataFrame:
    """index, text, label, written_by, genre (the file's name without its ending), errors: labels must be 0 or 1."""
    raw = spark.read.schema("index string, text string, label string, written_by string").json(path)
    genre = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    x = raw.select("index", "text", F.expr("try_cast(label as int)").alias("label"), "written_by", genre.alias("genre"))
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label"), F.when(F.coalesce(T.trim("text"), F.lit("")) == "", "text")))
    return x.withColumn("errors", bad)


def read_prose_tree(spark: SparkSession, path: str, endings: tuple[str, ...] = ("md", "mdx", "txt")) -> DataFrame:
    """path, text of every file below a folder with one of the endings."""
    read = lambda e: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{e}").text(path, wholetext=True)
    return reduce(DataFrame.unionByName, [read(e).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")) for e in endings])


def select_lang_files(df: DataFrame, lang: str, default: str = "en") -> DataFrame:
    """Files of a language by a suffix before the ending (page.ko.md); files without one are of the default language."""
    mark = F.regexp_extract("path", r"\.([a-z]{2})\.[a-z]+$", 1)
    return df.filter((mark == lang) | ((mark == "") & F.lit(lang == default)))


def flat(block: str) -> dict[str, str]:
    """Indented keys, lists and scalars as one map: a/b/0 -> value. Comments and quotes go."""
    out: dict[str, str] = {}
    stack: list[tuple[float, str]] = []  # (indent, name) of the open keys and list items
    counts: dict[str, int] = {}
    for line in block.split("\n"):
        m = re.match(r"^(\s*)(- +)?(?:([\w.$-]+):(?=\s|$))?\s*(.*)$", line)
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, key, rest = len(m[1]), m[3], re.sub(r"(^|\s+)#.*$", "", m[4]).strip()
        if m[2]:  # a list item belongs to the last key at its indent or left of it
            while stack and stack[-1][0] > indent:
                stack.pop()
            base = "/".join(k for _, k in stack)
            n = counts[base] = counts.get(base, -1) + 1
            if key is None:
                out[f"{base}/{n}"] = rest.strip("\"'")
                continue
            stack.append((indent + 0.5, str(n)))
            indent += len(m[2])
        else:
            while stack and stack[-1][0] >= indent:
                stack.pop()
        if key is None:
            continue
        path = "/".join([*(k for _, k in stack), key])
        if not rest:
            stack.append((indent, key))
        elif rest.startswith("[") and rest.endswith("]"):
            out |= {f"{path}/{i}": v.strip().strip("\"'") for i, v in enumerate(x for x in rest[1:-1].split(",") if x.strip())}
        else:
            out[path] = rest.strip("\"'")
    return out


def parse_front_matter(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds meta (path -> value; empty without front matter) and body."""
    import json

    @F.pandas_udf("string")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(flat(x)) if x else "{}")

    whole = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)(.*)\z"
    head = F.regexp_extract(F.col(column), whole, 1)
    body = F.when(F.col(column).rlike(whole), F.regexp_extract(F.col(column), whole, 2)).otherwise(F.col(column))
    return df.withColumns({"meta": F.from_json(keys(head), "map<string,string>"), "body": T.trim(body)})


def read_lexicon(spark: SparkSession, path: str, priority: int = 0) -> DataFrame:
    """lang, kind (strict or phrase), entry, priority from files named ai-<lang>.md: bullets below the two known headings."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"-([a-z]{2})\.md$", 1).alias("lang"), F.posexplode(F.split("value", r"\r?\n", -1)).alias("i", "line"))
    line = T.trim("line")
    kind = F.when(F.lower(line).contains("strict matches"), "strict").when(F.lower(line).contains("multi-word phrases"), "phrase").otherwise("none")
    section = F.last(F.when(line.startswith("## "), kind), ignorenulls=True).over(Window.partitionBy("lang").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    x = files.withColumns({"kind": section, "line": line}).filter(F.col("kind").isin("strict", "phrase") & F.col("line").startswith("- "))
    return x.select("lang", "kind", T.trim(F.expr("substring(line, 3)")).alias("entry"), F.lit(priority).alias("priority")).filter(F.col("entry") != "")


def shadow(*lexicons: DataFrame) -> DataFrame:
    """Of several lexicons, that of the highest priority for each language, as a whole."""
    every = reduce(DataFrame.unionByName, lexicons)
    top = every.groupBy("lang").agg(F.max("priority").alias("priority"))
    return every.join(top, ["lang", "priority"], "left_semi").select("lang", "kind", "entry")


def read_patterns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, watch terms, documented overlaps) from packs with front matter and sections headed `### <number>. <title>`."""
    packs = parse_front_matter(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))
    packs = packs.select("meta", F.col("meta")["pack"].alias("pack"), F.col("meta")["language"].alias("lang"), "body")
    sections = packs.select("pack", "lang", F.explode(F.split("body", r"(?m)^(?=### \d+\. )", -1)).alias("s")).filter(F.col("s").rlike(r"\A### \d+\. "))
    number = F.regexp_extract("s", r"\A### (\d+)\. ", 1).cast("int")
    rows = sections.select(F.concat_ws(":", "pack", number).alias("pattern_id"), "lang", "pack", F.expr("substring(pack, length(lang) + 2)").alias("category"), number.alias("number"), T.trim(F.regexp_extract("s", r"\A### \d+\. ([^\n]*)", 1)).alias("title"), "s")
    listed = F.regexp_extract("s", r"(?m)^\*\*(?:Watch words|Watch terms|Watch)[^:*]*:\*\*[ \t]*([^\n]*)", 1)
    terms = rows.select("pattern_id", "lang", F.explode(F.split(listed, r"\s*[,、]\s*", -1)).alias("term")).select("pattern_id", "lang", T.trim(F.regexp_replace("term", "[\"“”`]", "")).alias("term")).filter(F.col("term") != "").distinct()
    edges = packs.filter(F.exists(F.map_keys("meta"), lambda k: k.startswith("dedupe-with/")))
    one = lambda f: F.col("meta")[F.concat(F.lit("dedupe-with/"), F.col("n").cast("string"), F.lit(f"/{f}"))]
    numbers = F.explode(F.array_distinct(F.transform(F.filter(F.map_keys("meta"), lambda k: k.startswith("dedupe-with/")), lambda k: F.split(k, "/")[1])))
    overlaps = edges.withColumn("n", numbers).select(one("source").alias("source"), one("target").alias("target"), F.coalesce(one("owner"), one("source")).alias("owner"), F.coalesce(one("reason"), F.lit("")).alias("reason")).filter("source is not null and target is not null")
    return rows.drop("s"), terms, overlaps


#: What a policy must say, may not say, and can do to a pattern.
POLICY_TEXTS, POLICY_LISTS = ("name", "version", "scope", "purpose"), ("audience", "structure", "style", "avoid")
POLICY_FOREIGN = ("persona", "register", "profile", "tone", "formality", "verification", "mps", "fidelity")
POLICY_ACTIONS = ("suppress", "reduce", "amplify")


def read_policies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(document_type, errors) and (document_type, lang, pattern_no, action) from files named after their document type."""
    x = parse_front_matter(spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("document_type"), F.col("value").alias("text")))
    get = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    rules = F.filter(F.map_entries("meta"), lambda e: e["key"].startswith("pattern-overrides/"))
    wrong = [F.when(get("document-type") != F.col("document_type"), "document-type")]
    wrong += [F.when(get(k) == "", k) for k in POLICY_TEXTS] + [F.when(get(f"{k}/0") == "", k) for k in POLICY_LISTS] + [F.when(F.map_contains_key("meta", k), f"foreign: {k}") for k in POLICY_FOREIGN]
    wrong += [F.when(F.exists(rules, lambda e: ~e["key"].rlike(r"^pattern-overrides/(ko|en|zh|ja)/\d+$")), "override language"), F.when(F.exists(rules, lambda e: ~e["value"].isin(*POLICY_ACTIONS)), "override action")]
    rows = x.select("document_type", F.explode(rules).alias("e")).select("document_type", F.split("e.key", "/")[1].alias("lang"), F.expr("try_cast(split(e.key, '/')[2] as int)").alias("pattern_no"), F.col("e.value").alias("action"))
    return x.select("document_type", F.array_compact(F.array(*wrong)).alias("errors")), rows.filter(F.col("action").isin(*POLICY_ACTIONS))


def read_personas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(persona_id, lang, allow, avoid, errors) and (persona_id, lang, feature, target, tolerance, weight, max) from persona files."""
    x = parse_front_matter(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))
    listed = lambda k: F.transform(F.array_sort(F.filter(F.map_entries("meta"), lambda e: e["key"].startswith(k))), lambda e: e["value"])
    bad = F.array_compact(F.array(F.when(F.col("meta")["id"].isNull(), "id"), F.when(~F.coalesce(F.col("meta")["lang"].isin("ko", "en", "zh", "ja"), F.lit(False)), "lang")))
    people = x.select(F.col("meta")["id"].alias("persona_id"), F.col("meta")["lang"].alias("lang"), listed("blocks/preferred_words/allow/").alias("allow"), listed("blocks/preferred_words/avoid/").alias("avoid"), bad.alias("errors"))
    cells = x.select(F.col("meta")["id"].alias("persona_id"), F.col("meta")["lang"].alias("lang"), F.explode("meta").alias("k", "v")).filter(F.col("k").rlike(r"^target_features/[^/]+/(target|tolerance|weight|max)$"))
    part = F.split("k", "/")
    targets = cells.select("persona_id", "lang", part[1].alias("feature"), part[2].alias("f"), F.expr("try_cast(v as double)").alias("v")).groupBy("persona_id", "lang", "feature").pivot("f", ["target", "tolerance", "weight", "max"]).agg(F.first("v"))
    return people, targets


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """id, resname, translate, locked, approved, source, target, state of each translation unit of XLIFF 1.2 files."""
    kind = "_id string, _resname string, _translate string, _locked string, _approved string, source string, target struct<_VALUE:string,_state:string>"
    x = spark.read.format("xml").option("rowTag", "trans-unit").schema(kind).load(path)
    return x.select(*[F.col(f"_{c}").alias(c) for c in ("id", "resname", "translate", "locked", "approved")], "source", F.col("target._VALUE").alias("target"), F.col("target._state").alias("state"))


#: Words that outside detectors use for the two verdicts.
HOT_WORDS, COLD_WORDS = ("ai", "ai-generated", "generated", "machine", "hot", "true", "yes"), ("human", "natural", "cold", "false", "no")


def read_detector_labels(spark: SparkSession, path: str) -> DataFrame:
    """fixture_id, detector, predicted (null for an unknown word), score from a file with a `results` list."""
    kind = "results array<struct<fixture_id:string,detector:string,label:string,predicted_hot:boolean,score:double>>"
    x = spark.read.schema(kind).option("multiLine", True).json(path).select(F.inline("results"))
    word = F.lower(F.trim("label"))
    return x.select("fixture_id", "detector", F.coalesce("predicted_hot", F.when(word.isin(*HOT_WORDS), True).when(word.isin(*COLD_WORDS), False)).alias("predicted"), "score")

