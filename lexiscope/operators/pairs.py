"""Original against rewrite: numbers, terms, negations, churn, persona match, comparisons and choices."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.functions.text import round_half_up as r6
from lexiscope.operators.numbers import claims_of, compared

# --- numbers ---------------------------------------------------------------------------------


def numeric_claims(texts: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """texts(key, lang, column) -> key, claims, reason: the numeric claims of each text in order, or why it can't be read."""

    @F.pandas_udf("struct<claims:array<string>,reason:string>")
    def run(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([claims_of(t, g) for t, g in zip(text, lang, strict=True)], columns=["claims", "reason"])

    return texts.select(*key, run(column, F.coalesce("lang", F.lit("en"))).alias("c")).select(*key, "c.claims", "c.reason")


def numbers_kept() -> Column:
    """A struct of missing, added, safe and reason from pairs(lang, original, rewrite)."""

    @F.pandas_udf("struct<missing:int,added:int,safe:boolean,reason:string>")
    def run(original: pd.Series, rewrite: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = []
        for o, r, g in zip(original, rewrite, lang, strict=True):
            read = claims_of(o, g)
            other = read if o == r else claims_of(r, g)
            safe, reason = compared(read, other)
            a, b = Counter(read[0]), Counter(other[0])
            rows.append(((a - b).total(), (b - a).total(), safe, reason))
        return pd.DataFrame(rows, columns=["missing", "added", "safe", "reason"])

    return run("original", "rewrite", F.coalesce("lang", F.lit("en")))


def number_safety(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, lang, original, rewrite) -> key, missing, added, safe, reason: both sides must be readable and make the same claims equally often."""
    return pairs.select(key, numbers_kept().alias("n")).select(key, "n.*")


def numbers_in(c: str | Column) -> Column:
    """Numbers as written, without their grouping commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(T.col(c), F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "")))


def dropped_numbers(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("dropped", F.array_except(numbers_in("original"), numbers_in("rewrite")))


# --- terms, negations, length ----------------------------------------------------------------

SCRIPT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
HAN_KANA = re.compile(r"[\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fd-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003134f]")


def content_tokens(c: str | Column, lang: Column) -> Column:
    low = F.transform(T.tokenize(c, lang), F.lower)
    return F.filter(low, lambda t: (F.char_length(t) >= 2) | t.rlike(SCRIPT))


def recall_of() -> Column:
    """A struct of rare and survived from pairs(lang, original, rewrite): of tokens that the original has once or twice, those that the rewrite has too, or, if long or Chinese or Japanese, contains."""

    @F.pandas_udf("struct<rare:int,survived:int>")
    def run(original: pd.Series, rewrite: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for o, t, r in zip(original, rewrite, text, strict=True):
            rare = [w for w, n in Counter(o).items() if n <= 2]
            have, r = set(t), unicodedata.normalize("NFC", r or "")
            rows.append((len(rare), sum(w in have or (len(w) >= 5 or bool(HAN_KANA.search(w))) and w in r for w in rare)))
        return pd.DataFrame(rows, columns=["rare", "survived"])

    tokens = lambda c: F.coalesce(content_tokens(c, F.col("lang")), F.expr("cast(array() as array<string>)"))
    return run(tokens("original"), tokens("rewrite"), F.lower("rewrite"))


def rare_token_recall(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, lang, original, rewrite) -> key, rare, survived, recall of words that the original has once or twice; null under three of them."""
    return pairs.select(key, recall_of().alias("n")).select(key, "n.*").withColumn("recall", F.when(F.col("rare") >= 3, r6(F.col("survived") / F.col("rare"))))


#: Words that deny.
NEGATIONS = ("no", "not", "never", "none", "neither", "nor", "cannot", "without", "nobody", "nothing", "nowhere")


def negations(c: str | Column, lang: Column | None = None) -> Column:
    words = F.regexp_extract_all(F.lower(T.col(c)), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))
    en = F.size(F.filter(words, lambda w: w.isin(*NEGATIONS) | F.endswith(w, F.lit("n't"))))
    if lang is None:
        return en
    ja = F.regexp_count(T.col(c), F.lit(r"ない|ません|ではない|なかった|ぬ(?=[。、！？\s]|$)|ず(?=[。、！？\s]|$)"))
    zh = F.regexp_count(T.col(c), F.lit("[不没無无非未別别]"))
    ko = F.size(F.filter(T.tokenize(c), lambda w: w.rlike("(^(안|못)$)|않|없|아니")))
    return F.when(lang == "ja", ja).when(lang == "zh", zh).when(lang == "ko", ko).otherwise(en)


def length_ratio(original: Column, rewrite: Column) -> Column:
    """Tokens of the rewrite for each of the original; 1 for two empty texts, infinite for an empty original alone."""
    return F.when(original > 0, rewrite / original).otherwise(F.when(rewrite == 0, 1.0).otherwise(float("inf")))


def meaning_proxy(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, lang, original, rewrite) -> the four signals, reasons, and the worst severity: pass, warn or fail."""
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("original", "rewrite")})
    n = lambda c: F.size(T.tokenize(c, F.col("lang")))
    x = pairs.select(
        key, F.size(F.array_except(numbers_in("original"), numbers_in("rewrite"))).alias("dropped"), (negations("rewrite", F.col("lang")) - negations("original", F.col("lang"))).alias("negation_delta"),
        length_ratio(n("original"), n("rewrite")).alias("ratio"), recall_of().alias("r"), numbers_kept().alias("s"),
    )
    x = x.select(key, "dropped", "negation_delta", "ratio", F.when(F.col("r.rare") >= 3, r6(F.col("r.survived") / F.col("r.rare"))).alias("recall"), "s.safe", F.col("s.reason").alias("number_reason"))
    codes = {
        "numbers": F.when(~F.col("safe"), 2).when(F.col("dropped") > 0, 1).otherwise(0), "terms": F.when(F.col("recall") < 0.3, 2).when(F.col("recall") < 0.5, 1).otherwise(0),
        "negation": F.least(F.abs("negation_delta"), F.lit(2)), "length": F.when((F.col("ratio") < 0.4) | (F.col("ratio") > 2.5), 2).otherwise(0),
    }
    worst = F.greatest(*codes.values())
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c > 0, n) for n, c in codes.items()])), ",")
    return x.select(key, "dropped", "negation_delta", r6(F.col("ratio"), 4).alias("ratio"), "recall", "safe", "number_reason", F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("severity"), reasons.alias("reasons"))


def anchor_mps(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, rewrite, anchors array) -> key, anchors, passed, mps: the share of anchors the rewrite still says."""
    text = T.norm_match("rewrite")
    ok = F.size(F.filter("anchors", lambda a: F.contains(text, F.lower(F.trim(F.regexp_replace(a, r"\s+", " "))))))
    return pairs.select(key, F.size("anchors").alias("anchors"), ok.alias("passed")).withColumn("mps", r6(F.try_divide(F.col("passed") * 100.0, "anchors"), 4))


def rewrite_quality(df: DataFrame) -> DataFrame:
    """df(before, after, facts, kept, ratio): meaning safety (0 to 100) as the lesser of the facts kept and the length's points, the safe gain, and pass, warn or fail."""
    length = F.when(F.col("ratio").between(0.7, 1.3), 100.0).when(F.col("ratio").between(0.5, 1.5), 80.0).when(F.col("ratio").between(0.3, 2.0), 60.0).when(F.col("ratio") > 0, 30.0).otherwise(0.0)
    facts = F.coalesce(F.try_divide(F.col("kept") * 100.0, "facts"), F.lit(100.0))
    gain = F.greatest(r6(F.col("before") - F.col("after"), 1), F.lit(0.0))
    x = df.withColumn("safety", r6(F.least(facts, length), 1)).withColumn("gain", r6(gain * F.col("safety") / 100, 1))
    safe = (F.col("safety") >= 70) & (F.col("gain") > 0)
    return x.withColumn("quality", F.when(safe & (F.col("after") <= 30), "pass").when(safe, "warn").otherwise("fail"))


# --- churn and diffs -------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def edit_churn(original: str | Column, rewrite: str | Column, variant: str = "max") -> Column:
    """1 - LCS / longer text, or with "sum" (n + m - 2 LCS) / (n + m)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            p, q = (TOKEN.findall(unicodedata.normalize("NFC", t or "")) for t in (x, y))
            if not p and not q:
                return 0.0
            k = lcs(p, q)
            return 1 - k / max(len(p), len(q)) if variant == "max" else (len(p) + len(q) - 2 * k) / (len(p) + len(q))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(T.col(original), T.col(rewrite))


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of a longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def segments(a: list[str], b: list[str], cells: int, sep: str) -> list[tuple[str, str, str]]:
    """(kind, before, after) in order: same, changed, removed or added. Above the number of cells, blocks match by position alone."""
    if len(a) * len(b) > cells:
        match = [(i, i) for i in range(min(len(a), len(b))) if a[i] == b[i]]
    else:
        match = aligned(a, b)
    out, i, j = [], 0, 0
    for x, y in [*match, (len(a), len(b))]:
        old, new = sep.join(a[i:x]), sep.join(b[j:y])
        if i < x or j < y:
            out.append(("changed" if i < x and j < y else "removed" if i < x else "added", old, new))
        if x < len(a) and y < len(b):
            out.append(("same", a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def diff(pairs: DataFrame, key: str, unit: str) -> DataFrame:
    """pairs(key, original, rewrite) -> key, seq, kind, before, after: by block (lines that aren't blank) or word, equal stretches of words merged."""
    cells = {"block": 20_000, "word": 40_000}[unit]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, o, r in zip(b[key], b["original"], b["rewrite"], strict=True):
                cut = (lambda t: [x.strip() for x in (t or "").split("\n") if x.strip()]) if unit == "block" else (lambda t: (t or "").split())
                merged: list[list] = []
                for kind, x, y in segments(cut(o), cut(r), cells, "\n" if unit == "block" else " "):
                    if unit == "word" and merged and kind == "same" == merged[-1][0]:
                        merged[-1][1] += " " + x
                        merged[-1][2] += " " + y
                    else:
                        merged.append([kind, x, y])
                rows += [(k, i, *m) for i, m in enumerate(merged)]
            yield pd.DataFrame(rows, columns=[key, "seq", "kind", "before", "after"])

    return pairs.select(key, "original", "rewrite").mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, seq int, kind string, before string, after string")


def similarity(a: list[str], b: list[str]) -> np.ndarray:
    """Dice similarity of each block with each, over bags of neighbouring characters without white space."""
    holders: dict[str, list[tuple[int, int]]] = {}
    size = np.zeros(len(b))
    bags = [[Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in ("".join(t.split()) for t in side)] for side in (a, b)]
    for j, bag in enumerate(bags[1]):
        size[j] = bag.total()
        for g, n in bag.items():
            holders.setdefault(g, []).append((j, n))
    out = np.zeros((len(a), len(b)))
    for i, bag in enumerate(bags[0]):
        for g, n in bag.items():
            for j, m in holders.get(g, ()):
                out[i, j] += min(n, m)
        out[i] *= 2 / np.maximum(size + bag.total(), 1)
    return out


CELLS = 4_000_000


def best_rows(sim: np.ndarray, least: float) -> np.ndarray:
    """The best sums of similarities of monotonic pairings, for each row and column (one more of both)."""
    out = np.zeros((sim.shape[0] + 1, sim.shape[1] + 1))
    for i, row in enumerate(sim, 1):
        pair = np.where(row >= least, out[i - 1, :-1] + row, -np.inf)
        out[i, 1:] = np.maximum.accumulate(np.maximum(out[i - 1, 1:], pair))
    return out


def last_row(a: list[str], b: list[str], least: float) -> np.ndarray:
    """The last row of best_rows(), some rows at a time."""
    low = np.zeros(len(b) + 1)
    step = max(1, CELLS // (len(b) + 1))
    for at in range(0, len(a), step):
        for row in similarity(a[at : at + step], b):
            pair = np.where(row >= least, low[:-1] + row, -np.inf)
            low = np.concatenate([[0.0], np.maximum.accumulate(np.maximum(low[1:], pair))])
    return low


def paired(a: list[str], b: list[str], least: float, i0: int = 0, j0: int = 0) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of the monotonic pairing with the largest sum; large tables are halved, so memory stays bounded."""
    if not a or not b:
        return []
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        at = int(np.argmax(last_row(a[:half], b, least) + last_row(a[half:][::-1], b[::-1], least)[::-1]))
        return paired(a[:half], b[:at], least, i0, j0) + paired(a[half:], b[at:], least, i0 + half, j0 + at)
    sim = similarity(a, b)
    best = best_rows(sim, least)
    out, i, j = [], len(a), len(b)
    while i and j:
        s = sim[i - 1, j - 1]
        if s >= least and best[i, j] == best[i - 1, j - 1] + s:
            out.append((i0 + i - 1, j0 + j - 1, float(s)))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_blocks(pairs: DataFrame, key: str, least: float = 0.25) -> DataFrame:
    """pairs(key, original, rewrite) -> key, i, j, dice: blocks of the original with their partners in the rewrite, in order and without reuse, so that the sum of similarities is largest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, o, r in zip(b[key], b["original"], b["rewrite"], strict=True):
                old, new = ([x.strip() for x in (t or "").split("\n") if x.strip()] for t in (o, r))
                rows += [(k, i, j, round(s, 6)) for i, j, s in paired(old, new, least)]
            yield pd.DataFrame(rows, columns=[key, "i", "j", "dice"])

    return pairs.select(key, "original", "rewrite").mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, i int, j int, dice double")


def size_delta(pairs: DataFrame) -> DataFrame:
    words = lambda c: F.size(T.non_empty(F.split(T.col(c), r"\s+", -1)))
    return pairs.withColumns({"chars_delta": F.char_length("rewrite") - F.char_length("original"), "words_delta": words("rewrite") - words("original")})


# --- persona ---------------------------------------------------------------------------------


def persona_match(features: DataFrame, names: list[str], targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """features(key, names, churn if known), targets(persona_id, feature, target, tolerance, weight) -> key, persona_id, score.

    80 points fall with the weighted distance (at most three tolerances), 20 follow the weighted cosine. Up to 20
    each are taken off for more avoided phrases than the target of lexicon_density_avoid allows, and for more
    churn than the target of overEditChurn."""
    churn = F.col("churn").cast("double") if "churn" in features.columns else F.lit(None).cast("double")
    long = features.select(key, churn.alias("churn"), F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("x")) for n in names])))
    avoid = F.col("feature") == "lexicon_density_avoid"
    bounds = targets.groupBy("persona_id").agg(
        F.max(F.when(avoid, F.col("target"))).alias("avoid_target"), F.max(F.when(avoid, F.col("tolerance"))).alias("avoid_tolerance"), F.max(F.when(F.col("feature") == "overEditChurn", F.col("target"))).alias("churn_max")
    )
    j = long.join(targets.filter("weight > 0 and tolerance > 0 and feature <> 'overEditChurn'"), "feature")
    z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("x") - F.col("target")) / F.col("tolerance")))
    wx, wt = F.col("x") * F.col("weight"), F.col("target") * F.col("weight")
    g = j.groupBy(key, "persona_id").agg(F.sqrt(F.try_divide(F.sum(F.col("weight") * z * z), F.sum("weight"))).alias("d"), F.sum(wx * wt).alias("dot"), F.sum(wx * wx).alias("xx"), F.sum(wt * wt).alias("tt"), F.first("churn").alias("churn"))
    if "lexicon_density_avoid" in names:
        g = g.join(features.select(key, F.coalesce(F.col("lexicon_density_avoid").cast("double"), F.lit(0.0)).alias("avoid")), key)
    else:
        g = g.withColumn("avoid", F.lit(0.0))
    g = g.join(bounds, "persona_id")
    cos = F.when((F.col("xx") > 0) & (F.col("tt") > 0), F.col("dot") / (F.sqrt("xx") * F.sqrt("tt"))).otherwise(0.0)
    score = 80 * (1 - F.least(F.coalesce("d", F.lit(0.0)), F.lit(3.0)) / 3) + 20 * F.greatest(cos, F.lit(0.0))
    spare = F.coalesce("avoid_tolerance", F.lit(1.0))
    excess = F.greatest(F.lit(0.0), F.col("avoid") - F.coalesce("avoid_target", F.lit(0.0)) - spare)
    too_many = F.least(F.lit(20.0), excess / F.greatest(spare, F.lit(1.0)) * 5)
    over = F.when(F.col("churn") > F.col("churn_max"), F.least(F.lit(20.0), (F.col("churn") - F.col("churn_max")) / F.greatest(F.col("churn_max"), F.lit(0.01)) * 20)).otherwise(0.0)
    return g.select(key, "persona_id", r6(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score - too_many - over)), 4).alias("score"))


def persona_gate(df: DataFrame, match: float = 70.0, churn: float = 0.45) -> DataFrame:
    """df(score, churn) with passed and advice."""
    advice = F.array_compact(F.array(F.when(F.col("score") < match, "match"), F.when(F.col("churn") > churn, "churn")))
    return df.withColumn("advice", F.array_join(advice, ",")).withColumn("passed", F.col("advice") == "")


#: Tolerances of targets that come from a sample.
TOLERANCES = {"sentence_opener_diversity": 0.2, "burstiness_cv": 0.15, "comma_per_sentence": 0.5, "mattr": 0.1}


def derive_targets(features: DataFrame, tolerances: dict[str, float] = TOLERANCES, weight: float = 0.1) -> DataFrame:
    """feature, target, tolerance, weight from the means of sample texts."""
    means = features.agg(*[r6(F.avg(n), 5).alias(n) for n in tolerances])
    return means.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("target"), F.lit(t).alias("tolerance")) for n, t in tolerances.items()]))).withColumn("weight", F.lit(weight))


def ablation_aggregate(df: DataFrame, by: list[str]) -> DataFrame:
    """df(base_*, treat_* of match, mps, fidelity, churn; winner) -> mean change, win rate, pass rates of both sides, and whether the treatment passes."""
    passed = lambda s: {"mps": F.col(f"{s}_mps") >= 70, "fidelity": F.col(f"{s}_fidelity") >= 70, "churn": F.col(f"{s}_churn") <= 0.45}
    rate = lambda c: F.avg(c.cast("double"))
    g = df.groupBy(*by).agg(F.avg(F.col("treat_match") - F.col("base_match")).alias("delta"), rate(F.col("winner") == "treatment").alias("wins"), *[rate(c).alias(f"{s}_{n}_rate") for s in ("base", "treat") for n, c in passed(s).items()])
    lost = lambda n: F.col(f"base_{n}_rate") - F.col(f"treat_{n}_rate")
    ok = (F.col("delta") >= 5) & (F.col("wins") >= 0.55) & (lost("mps") <= 0.01) & (lost("fidelity") <= 0.01) & (lost("churn") <= 0.03)
    drop = F.greatest(lost("mps"), lost("fidelity"), lost("churn"), F.lit(0.0))
    return g.select(*by, r6(F.col("delta"), 4).alias("delta"), r6(F.col("wins"), 4).alias("wins"), r6(drop, 4).alias("safety_drop"), ok.alias("passes"))


def ablation_decision(rounds: DataFrame, by: list[str], order: str) -> DataFrame:
    """rounds(delta, wins, safety_drop, passes): two failures in a row fall back, else a pass promotes."""
    fail = ~F.col("passes") | (F.col("delta") < 3) | (F.col("wins") < 0.52) | (F.col("safety_drop") > 0.03)
    w = Window.partitionBy(*by).orderBy(order)
    x = rounds.withColumn("fail", fail).withColumn("twice", F.col("fail") & F.coalesce(F.lag("fail").over(w), F.lit(False)))
    g = x.groupBy(*by).agg(F.max("twice").alias("t"), F.min("fail").alias("f"))
    return g.select(*by, F.when(F.col("t"), "fallback-bridge-only").when(~F.col("f"), "promote-thresholds").otherwise("keep-placeholder").alias("decision"))


def recommend_thresholds(df: DataFrame, by: str, value: str, least: float = 70.0) -> DataFrame:
    """by, n, threshold: the last value of the lowest quarter (the lowest of fewer than eight), rounded down, `least` at least.

    The order statistic is found in counts of distinct values, so no task sorts a whole group of rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(by).agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    at = F.greatest(F.floor(F.col("n") * 0.25) - 1, F.lit(0))
    x = counts.withColumn("upto", upto).join(total, by).filter(F.col("upto") > at)
    return x.groupBy(by, "n").agg(F.min(value).alias("v")).select(by, "n", F.greatest(F.lit(least), F.floor("v").cast("double")).alias("threshold"))


def pick_winner(df: DataFrame, item: str, mps: float = 70.0, fidelity: float = 70.0) -> DataFrame:
    """The entry of each item with the lowest score, then churn, of those above both floors."""
    w = Window.partitionBy(item).orderBy("score", "churn", "config")
    return df.filter((F.col("mps") >= mps) & (F.col("fidelity") >= fidelity)).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ab_summary(df: DataFrame, item: str) -> DataFrame:
    """df(item, config, score, churn, ...): per config entries, means, wins, and the mean change against the first config on the same items."""
    wins = pick_winner(df, item).groupBy("config").agg(F.count("*").alias("wins"))
    first = df.agg(F.min("config").alias("c"))
    base = df.join(F.broadcast(first), df.config == first.c).select(item, F.col("score").alias("__base"))  # one row
    g = df.join(base, item, "left").groupBy("config").agg(F.count("*").alias("n"), r6(F.avg("score"), 4).alias("score"), r6(F.avg("churn"), 4).alias("churn"), r6(F.avg(F.col("score") - F.col("__base")), 4).alias("delta"))
    return g.join(wins, "config", "left").na.fill(0, ["wins"])


def select_iteration(df: DataFrame, item: str, target: float = 30.0, plateau: float = 2.0, most: int = 5, floor: float = 70.0) -> DataFrame:
    """df(item, iteration from 1, before, after, fidelity, mps, combined) -> item, stop iteration, reason, and the best accepted score and its iteration (0: the original)."""
    w = Window.partitionBy(item).orderBy("iteration")
    x = df.withColumn("__prev", F.lag("combined").over(w))
    reason = (
        F.when(F.col("fidelity") < floor, "fidelity-floor").when(F.col("mps").isNull(), "mps-failure").when(F.col("mps") < floor, "mps-floor").when(F.col("after") <= target, "target")
        .when(F.round(F.col("__prev") - F.col("combined"), 6) < 0, "regression").when(F.col("before") - F.col("after") <= plateau, "plateau").when(F.col("iteration") >= most, "max-iterations")
    )
    x = x.withColumn("reason", reason).withColumn("stop", F.min(F.when(F.col("reason").isNotNull(), F.col("iteration"))).over(Window.partitionBy(item)))
    x = x.filter(F.col("stop").isNull() | (F.col("iteration") <= F.col("stop")))
    accepted = ~F.coalesce(F.col("reason").isin("fidelity-floor", "mps-failure", "mps-floor", "regression"), F.lit(False))
    g = x.groupBy(item).agg(F.max("stop").alias("stop"), F.max_by("reason", "iteration").alias("reason"), F.min_by("before", "iteration").alias("start"), F.min(F.when(accepted, F.struct("after", "iteration"))).alias("best"))
    better = F.coalesce(F.col("best.after") < F.col("start"), F.lit(False))
    return g.select(item, "stop", F.coalesce("reason", F.lit("completed")).alias("reason"), F.when(better, F.col("best.after")).otherwise(F.col("start")).alias("score"), F.when(better, F.col("best.iteration")).otherwise(0).alias("iteration"))


def compare_variants(df: DataFrame) -> DataFrame:
    """df(base_match, treat_match, base_ok, treat_ok) with delta and winner: the side that passes its floors, else the better match."""
    d = F.col("treat_match") - F.col("base_match")
    winner = F.when(F.col("treat_ok") & ~F.col("base_ok"), "treatment").when(F.col("base_ok") & ~F.col("treat_ok"), "baseline").when(d > 0, "treatment").when(d < 0, "baseline").otherwise("tie")
    return df.withColumns({"delta": r6(d, 4), "winner": winner})


def grader_check(df: DataFrame, floor: float = 70.0) -> DataFrame:
    """df(mps, fidelity, expected: pass or fail): counts of right verdicts, of fails that pass (dangerous) and passes that fail (blocking)."""
    ok = (F.col("mps") >= floor) & (F.col("fidelity") >= floor)
    return df.agg(F.count("*").alias("n"), F.count_if(ok == (F.col("expected") == "pass")).alias("right"), F.count_if(ok & (F.col("expected") == "fail")).alias("dangerous"), F.count_if(~ok & (F.col("expected") == "pass")).alias("blocking"))
