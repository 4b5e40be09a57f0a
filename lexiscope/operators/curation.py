"""Corpus curation: filters, validation, lookups and audits, balanced and budgeted takes, set operations, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.operators.ordering import running

# --- filters ---------------------------------------------------------------------------------

#: Scripts by language: pattern, least count, least share of letters and digits, and what else must or must not be there.
SCRIPTS = {
    "ko": (r"[ㄱ-ㆎ가-힣]", 25, 0.35, None),
    "ja": (r"[぀-ゟ゠-ヿ一-鿿㐀-䶿]", 20, 0.30, (r"[぀-ヿ]", ">=", 5)),
    "zh": (r"[一-鿿㐀-䶿]", 25, 0.30, (r"[぀-ヿ]", "<=", 2)),
    "en": (r"[A-Za-z]", 40, 0.50, None),
}
BOILERPLATE = r"(?i)(본문듣기|말하기 속도|글자크기|인쇄하기|공유하기|목록|검색|닫기|저작권자|무단 전재|재배포 금지|자료출처|문의:|페이스북|트위터|카카오|Copyright|All rights reserved|View all|Apply now)"


def useful_paragraph(c: str | Column, lang: str = "en", least: int = 90, most: int = 700) -> Column:
    """A paragraph of prose in its language's script, of a fitting length, without boilerplate, links or many brackets."""
    x, (script, count, share, more) = T.col(c), SCRIPTS[lang]
    n = F.regexp_count(x, F.lit(script))
    letters = F.greatest(F.regexp_count(x, F.lit(r"[\p{L}\p{N}]")), F.lit(1))
    ok = F.char_length(x).between(least, most) & ~x.rlike(BOILERPLATE) & (n >= count) & (n >= share * letters)
    if more:
        k = F.regexp_count(x, F.lit(more[0]))
        ok = ok & ((k >= more[2]) if more[1] == ">=" else (k <= more[2]))
    return F.coalesce(ok & ~x.rlike(r"(?i)https?://") & (F.regexp_count(x, F.lit(r"[|{}\[\]<>]")) <= 5), F.lit(False))


ASIAN = r"[一-鿿぀-ヿ가-힯]"


def prose_like(c: str | Column) -> Column:
    """Five words or twelve Chinese, Japanese or Korean characters beside placeholders; no lone link or address."""
    t = T.trim(c)
    bare = T.trim(F.regexp_replace(t, r"%[0-9]*\$?[a-zA-Z]|%\{[^}]*\}|\{\d+\}|\{[a-zA-Z_][A-Za-z0-9_]*\}|<[^>]+>", " "))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+", -1)))
    ok = t.rlike(rf"[A-Za-z]|{ASIAN}") & ~t.rlike(r"(?i)^(https?://|mailto:)") & ~t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    return F.coalesce(ok & ((words >= 5) | (F.regexp_count(bare, F.lit(ASIAN)) >= 12)), F.lit(False))


#: Target states that may be edited.
STATES = ("translated", "needs-review-translation", "final", "signed-off")


def classify_segments(df: DataFrame) -> DataFrame:
    """df(translate, locked, approved, state, source, target) with reason (the first that rejects a segment) and select."""
    rules = [
        ((F.col("translate") == "no") | (F.col("locked") == "true") | (F.col("approved") == "no"), "locked"), (F.col("state").isNotNull() & ~F.col("state").isin(*STATES), "state_not_allowlisted"),
        (F.contains("target", F.lit("<![CDATA[")), "cdata_or_malformed"), (F.col("target").rlike("<[A-Za-z/]"), "inline_markup"), (F.coalesce(T.trim("target"), F.lit("")) == "", "empty_target"),
        (T.trim("target") == T.trim("source"), "untranslated"), (~prose_like("target"), "not_prose"),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(on, F.lit(False)), name) for on, name in rules])
    return df.withColumn("reason", reason).withColumn("select", F.col("reason").isNull())


#: Licences that let a text be passed on.
OPEN = ("repo-ok", "redistributable", "public", "public-domain", "cc0", "cc-by")
CLOSED = ("metadata-only", "private", "no-redistribution", "hash-only")


def can_redistribute(c: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(T.col(c))).isin(*OPEN), F.lit(False))


def select_fixture_rows(df: DataFrame) -> DataFrame:
    """df(text, redistribution, expected, predicted) with route: errors, refused or selected (a false positive that may be passed on)."""
    return df.withColumn("route", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "errors").when(~can_redistribute("redistribution"), "refused").when(~F.col("expected") & F.col("predicted"), "selected").otherwise("skipped"))


def clean_messages(df: DataFrame) -> DataFrame:
    """Chat lines of four characters or more without links, that open with no mention and no log stamp."""
    t = T.trim("text")
    return df.filter((F.char_length(t) >= 4) & ~t.rlike(r"https?://|www\.") & ~F.startswith(t, F.lit("@")) & ~F.startswith(t, F.lit("[20")))


#: What a manifest row must hold and may say.
REQUIRED = ("sample_id", "language", "class", "register", "model_family", "redistribution", "generated_at")
LANGUAGES = ("ko", "en", "zh", "ja")


def validate_manifest(df: DataFrame, classes: tuple[str, ...], registers: tuple[str, ...], families: tuple[str, ...]) -> DataFrame:
    """Adds errors and warnings (arrays of text) to each row, after trimming and lower-casing its enums. Nothing is dropped."""
    tidy = {c: F.lower(F.trim(F.col(c))) for c in ("language", "class", "register", "model_family", "redistribution")}
    x = df.withColumns(tidy | {"sample_id": F.trim("sample_id")})
    has = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    one_of = lambda c, names: has(c) & ~F.col(c).isin(*names)
    text = has("text") if "text" in df.columns else F.lit(False)
    errors = [F.when(~has(c), f"missing required field: {c}") for c in REQUIRED]
    errors += [F.when(one_of("language", LANGUAGES), "language is unknown"), F.when(one_of("class", classes), "class is unknown"), F.when(one_of("register", registers), "register is unknown")]
    errors += [F.when(has("generated_at") & F.try_to_timestamp("generated_at").isNull(), "generated_at is no time")]
    if "text" in df.columns:
        errors += [F.when(text & ~can_redistribute("redistribution"), "text may not be passed on")]
        if "text_hash" in df.columns:
            errors += [F.when(has("text_hash") & ~F.col("text_hash").rlike("^sha256:[0-9a-f]{64}$"), "text_hash is malformed"), F.when(text & has("text_hash") & (F.col("text_hash") != T.text_hash("text")), "text_hash differs")]
    warnings = [F.when(one_of("model_family", families), "model_family is unknown"), F.when(one_of("redistribution", OPEN + CLOSED), "redistribution is unknown")]
    return x.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(*warnings))})


# --- lookups and audits ----------------------------------------------------------------------


def canonicalize(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Replaces a trimmed, lower-cased value by its canonical one from aliases(alias, canonical); others stay."""
    a = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical"))
    x = df.withColumn(column, F.lower(F.trim(F.col(column))))
    return x.join(a, x[column] == a["__alias"], "left").withColumn(column, F.coalesce("__canonical", column)).drop("__alias", "__canonical")


def normalize_lang(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """A language tag onto a supported language by the whole tag, else by its base; null if neither is known."""
    a = aliases.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c"))
    b = aliases.select(F.col("alias").alias("__b"), F.col("canonical").alias("__d"))
    x = df.withColumn("__key", F.lower(F.trim(F.col(column)))).withColumn("__base", F.element_at(F.split("__key", "[-_]"), 1))
    x = x.join(a, F.col("__key") == F.col("__a"), "left").join(b, F.col("__base") == F.col("__b"), "left")
    return x.withColumn(column, F.coalesce("__c", "__d")).drop("__key", "__base", "__a", "__b", "__c", "__d")


def audit_provenance(lexicon: DataFrame, provenance: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: entries without provenance, provenance without an entry, and duplicates on either side."""
    twice = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(*keys, F.lit(name).alias("problem"))
    lone = lexicon.select(*keys).distinct().join(provenance, keys, "left_anti").withColumn("problem", F.lit("no-provenance"))
    orphan = provenance.select(*keys).distinct().join(lexicon, keys, "left_anti").withColumn("problem", F.lit("orphan"))
    return lone.unionByName(orphan).unionByName(twice(lexicon, "duplicate-entry")).unionByName(twice(provenance, "duplicate-provenance"))


def attach_text(manifest: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    return manifest.join(texts.filter(F.coalesce(T.trim("text"), F.lit("")) != "").select(key, "text"), key)


def join_runs(first: DataFrame, second: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """Rows of runs that share a key: the first two must have it, the third may."""
    named = lambda df, n: df.select(key, *[F.col(c).alias(f"{c}_{n}") for c in df.columns if c != key])
    return named(first, 1).join(named(second, 2), key).join(named(third, 3), key, "left")


def cooccurrence(hits: DataFrame) -> DataFrame:
    """hits(lang, doc_id, pattern): lang, a, b, n: documents of a language that hold both patterns. Pairs are within a document, bounded by the catalogue."""
    h = hits.select("lang", "doc_id", "pattern").distinct()
    a, b = h.withColumnRenamed("pattern", "a"), h.withColumnRenamed("pattern", "b")
    return a.join(b, ["lang", "doc_id"]).filter("a < b").groupBy("lang", "a", "b").agg(F.count("*").alias("n"))


def pattern_overlap(hits: DataFrame, documented: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Jaccard and overlap coefficient of patterns that meet, and whether documented(a, b) knows of the pair."""
    single = hits.select("lang", "doc_id", "pattern").distinct().groupBy("lang", "pattern").agg(F.count("*").alias("k"))
    x = cooccurrence(hits).join(single.select("lang", F.col("pattern").alias("a"), F.col("k").alias("ka")), ["lang", "a"]).join(single.select("lang", F.col("pattern").alias("b"), F.col("k").alias("kb")), ["lang", "b"])
    x = x.join(documented.select("a", "b", F.lit(True).alias("known")).distinct(), ["a", "b"], "left")
    j = F.col("n") / (F.col("ka") + F.col("kb") - F.col("n"))
    status = F.when(j < threshold, "below").when(F.coalesce("known", F.lit(False)), "documented").otherwise("undocumented")
    return x.select("lang", "a", "b", "n", T.round_half_up(j).alias("jaccard"), T.round_half_up(F.col("n") / F.least("ka", "kb")).alias("overlap"), status.alias("status"))


def coverage(df: DataFrame, dims: dict[str, list[str]], target: int = 25) -> DataFrame:
    """Every combination of the listed values with its row count and how many are missing to the target."""
    spark = df.sparkSession
    grid = reduce(DataFrame.crossJoin, [spark.createDataFrame([(v,) for v in values], f"{d} string") for d, values in dims.items()])  # as many rows as the lists say
    n = df.groupBy(*dims).agg(F.count("*").alias("n"))
    return grid.join(n, list(dims), "left").na.fill(0, ["n"]).withColumn("missing", F.greatest(F.lit(0), target - F.col("n")))


def unseen_keys(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in no row of `done`; a null key is never found there.

    Rows meet by the SHA-256 of all their keys, each with its length before it, so long texts aren't join keys and go
    through an exchange only if the result holds them. Two different keys don't share such a digest."""
    name = "_" * (1 + max(map(len, df.columns))) + "h"  # longer than any name there is
    said = [F.col(k).cast("string") for k in keys]
    digest = F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in said]), F.sha2(F.concat(*[x for c in said for x in (F.char_length(c).cast("string"), F.lit(":"), c)]), 256)).alias(name)
    return df.select("*", digest).join(done.select(digest).filter(F.col(name).isNotNull()).distinct(), name, "left_anti").select(*df.columns)


def pair_by_id(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    return before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)


def not_exported(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose text_hash and source are both new."""
    return df.join(existing.select("text_hash"), "text_hash", "left_anti").join(existing.select("source").filter("source is not null"), "source", "left_anti")


def exclude_seen(df: DataFrame, hashes: list[DataFrame], urls: list[DataFrame]) -> DataFrame:
    """Candidates whose text_hash or url is in no earlier corpus."""
    out = df
    if hashes:
        out = out.join(reduce(DataFrame.unionByName, [h.select("text_hash") for h in hashes]), "text_hash", "left_anti")
    if urls:
        out = out.join(reduce(DataFrame.unionByName, [u.select("url") for u in urls]), "url", "left_anti")
    return out


# --- takes and budgets -----------------------------------------------------------------------


def dedup_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in order, by a minimum that tasks take before the shuffle."""
    kept = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in df.columns if c not in order]).alias("__rest"))
    rest = [c for c in df.columns if c not in order]
    out = df.groupBy(key.alias("__key")).agg(F.min_by(kept, F.struct(*order)).alias("__first"))
    return out.select(*[F.col(f"__first.{c}") for c in order], *[F.col(f"__first.__rest.{c}") for c in rest]).select(*df.columns)


def balanced_take(df: DataFrame, n: int, key: str, order: list[str]) -> DataFrame:
    """n rows, taken in turn from the groups: first rows of all groups, then second ones, and so on.

    A row beyond the n-th of its group can't be taken, so groups are cut there before the last sort."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rn", rank).filter(F.col("__rn") <= n).orderBy("__rn", key).limit(n).drop("__rn")


def quota_sample(df: DataFrame, per_source: int = 8, per_register: int = 50) -> DataFrame:
    """df(id, text, source, register): the first row of each text, at most per_source of a source, then at most per_register of a register."""
    first = dedup_first(df.withColumn("__hash", T.text_hash("text")), F.col("__hash"), ["id"])
    a = first.withColumn("__s", F.row_number().over(Window.partitionBy("source").orderBy("id"))).filter(F.col("__s") <= per_source)
    return a.withColumn("__r", F.row_number().over(Window.partitionBy("register").orderBy("id"))).filter(F.col("__r") <= per_register).drop("__s", "__r", "__hash")


def priority_topk(df: DataFrame, group: str, priority: str, pos: str, k: int) -> DataFrame:
    """The k rows of each group of highest priority (ties: earliest), with their rank in the order of position."""
    w = Window.partitionBy(group)
    best = df.withColumn("__p", F.row_number().over(w.orderBy(F.col(priority).desc(), pos))).filter(F.col("__p") <= k)
    return best.withColumn("rank", F.row_number().over(w.orderBy(pos))).drop("__p")


def top_suspects(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("score").desc(), "doc_id").limit(n)


def suspect_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), T.round_half_up(F.avg("score"), 4).alias("mean"), F.count_if(F.col("score") > 50).alias("over_50"), F.count_if(F.col("score") == 0).alias("at_0"))


def trim_context(df: DataFrame, turns: int = 6, budget: int = 12_288) -> DataFrame:
    """The newest turns of each conversation, at most `turns`, as long as their bytes stay within the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    x = df.withColumns({"__n": F.row_number().over(w), "__b": F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return x.filter((F.col("__n") <= turns) & (F.col("__b") <= budget)).drop("__n", "__b")


def assign_ids(df: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Numbers new rows of each key, in an order that tells them apart, from one above the largest existing number."""
    top = existing.groupBy(key).agg(F.max("number").alias("__top"))
    x = running(df, [key], order, {"__before": F.lit(1)})
    return x.join(top, key, "left").select(*df.columns, (F.coalesce("__top", F.lit(0)) + F.col("__before") + 1).alias("number"))


def systematic_sample(df: DataFrame, every: int, bucket: Column, order: list[str]) -> DataFrame:
    """Every n-th row of the whole order. Rows are numbered inside buckets (which must follow the order), and a row per bucket gives the offset, so no task holds all."""
    x = df.withColumn("__b", bucket)
    sizes = x.groupBy("__b").agg(F.count("*").alias("__k"))
    offset = sizes.withColumn("__o", F.coalesce(F.sum("__k").over(Window.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__k")
    n = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return x.withColumn("__n", n).join(offset, "__b").filter((F.col("__n") + F.col("__o")) % every == 0).drop("__b", "__n", "__o")


def study_sample(human: DataFrame, machine: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """n human rows in turn from each register, with the machine rows of the same prompt; where there is none, machine rows of a sampled register stand in."""
    h = balanced_take(human, n, key, [order])
    paired = machine.join(h.select("prompt_id").distinct(), "prompt_id", "left_semi")
    missing = h.join(machine.select("prompt_id").distinct(), "prompt_id", "left_anti").select(key).distinct()
    spare = machine.join(h.select("prompt_id").distinct(), "prompt_id", "left_anti").join(missing, key, "left_semi")
    return h.withColumn("side", F.lit("human")).unionByName(paired.withColumn("side", F.lit("paired"))).unionByName(spare.withColumn("side", F.lit("control")))


def blind_sheet(df: DataFrame, item: str, condition: str, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): one condition of each item by a seeded hash, n of them in seeded order, numbered; the key tells which they are."""
    one = df.groupBy(item).agg(F.min_by(F.struct(*df.columns), F.xxhash64(item, condition, F.lit(seed))).alias("r")).select("r.*")
    picked = one.withColumn("__o", F.xxhash64(item, F.lit(seed + 1))).orderBy("__o", item).limit(n)
    numbered = picked.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__o", item))).drop("__o")
    return numbered.drop(condition), numbered.select("number", item, condition)


def hash_subset(df: DataFrame, k: int, by: str) -> DataFrame:
    """The k rows of each class with the smallest text hash."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("text_hash", "doc_id"))).filter(F.col("__n") <= k).drop("__n")


# --- set operations --------------------------------------------------------------------------


def union_corpora(*frames: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(all rows, ids that occur more than once)."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return every, every.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both sets of keys, of what they share, and of all."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count(F.col("a") + F.col("b")).alias("shared"), F.count("*").alias("union"))


def set_diff(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def bags_equal(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, equal: whether both sides of a key have each item equally often."""
    n = lambda df, s: df.groupBy(*by, item).agg(F.count("*").alias("n")).withColumn("n", s * F.col("n"))
    net = n(a, 1).unionByName(n(b, -1)).groupBy(*by, item).agg(F.sum("n").alias("n"))
    return net.groupBy(*by).agg((F.count_if(F.col("n") != 0) == 0).alias("equal"))


# --- sinks -----------------------------------------------------------------------------------


def split_public_private(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(public, private): the public side keeps a text only where its licence lets it pass on, and its hash always; the private side keeps the other texts."""
    hashed = df.withColumn("text_hash", T.text_hash("text"))
    ok = can_redistribute("redistribution")
    return hashed.withColumn("text", F.when(ok, F.col("text"))), hashed.filter(~ok)


def write_scored(df: DataFrame, path: str) -> None:
    df.drop("text").write.mode("overwrite").parquet(path)


def write_if_clean(df: DataFrame, path: str) -> None:
    """Writes only if no row has errors; ValueError else."""
    bad = df.filter(F.size("errors") > 0).select("errors").head(1)
    if bad:
        raise ValueError(f"rows have errors, such as {bad[0]['errors']}")
    df.write.mode("overwrite").parquet(path)


def report_tables(df: DataFrame) -> dict[str, DataFrame]:
    """df(lang, source, expected, predicted, score) as small named tables."""
    from lexiscope.operators import evaluation as E

    return {"counts": E.confusion(df), "by_lang": E.confusion(df, ["lang"]), "by_register": E.confusion(df, ["source"]), "cells": df.groupBy("lang", "source").agg(F.count("*").alias("n")), "ranking": E.ranking_summary(df)}
