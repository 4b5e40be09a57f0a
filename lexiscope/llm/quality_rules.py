"""Quality rules with risk-controlled thresholds.

Fixed base rules reject very short and very repetitive texts. On top, each rule compares one statistic
with a cutoff, and a stratum uses a set of cutoffs only if the labelled holdout proves it.

The holdout is split by a hash. One part proposes: quantiles of each statistic are the candidates, and
steps (a rule, a cutoff) are put in an order in which each rejects many bad documents for each good
one; the first n steps together are the n-th set of rules. The other part certifies: sets are tested
in that order, and the last one holds for which, with k of n good documents rejected, the exact
(Clopper-Pearson) upper bound on the rate of false rejections is within `risk`. As the order is fixed
before the test and the test ends at the first failure, no correction is needed for the number of
sets; the bounds are taken at delta / strata (Bonferroni), so that with a chance of 1 - delta all strata hold."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiscope.llm.common import materialise, slices, unused
from lexiscope.session import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Rules: a statistic, (count, divided by a count, and by a number), is too high from a cutoff on.
RULES = {
    "symbol_ratio": ("n_symbols", "n_words", 1.0),
    "repeat_ratio": ("n_repeat_words", "n_words", 1.0),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1.0),
    "shout_ratio": ("n_shout_words", "n_words", 1.0),
    "stutter_ratio": ("n_stutter_words", "n_words", 1.0),
    "word_length": ("word_chars", "n_words", 40.0),
}
#: Quantiles of good and of bad documents that are candidates; bad documents a step must reject for each good one.
GOOD_AT, BAD_AT, GAIN = (0.9, 0.95, 0.98, 0.99, 0.995, 1.0), (0.05, 0.1, 0.25, 0.5, 0.75, 0.9), 3
RISK, DELTA = 0.03, 0.05
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shout_words long, n_stutter_words long"
NAMES = [x.split()[0] for x in COUNTS.split(", ")]


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    ids: dict[str, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeats = 0
    if n >= 3:
        pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
        window = pair[:-1] * len(ids) + at[2:]
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        hit = np.zeros(n, bool)
        again = np.flatnonzero(times[back] >= 2)
        for j in range(3):
            hit[again + j] = True
        repeats = int(hit.sum())
    shout = sum(1 for w in words if len(w) >= 3 and w.isupper())
    stutter = int((at[1:] == at[:-1]).sum()) if n else 0
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats, len(lines), shout, stutter


def measured(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns `keep` of docs(text) and a struct of the counts, of each row."""
    prepare(docs.sparkSession)
    kinds = docs.select(*keep).schema.fields
    counts = StructType.fromDDL(COUNTS)
    at = len(keep)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [measure(t) for t in part.column(at).to_pylist()]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(NAMES))]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.StructArray.from_arrays(columns, NAMES)], [*keep, name])

    return docs.select(*keep, F.col("text").alias(unused(docs, "text")[0])).mapInArrow(run, StructType([*kinds, StructField(name, counts)]))


def statistics(m: str) -> F.Column:
    """Each rule's statistic, in their order, from a struct of counts; no words or lines: zero."""
    return F.array(*[F.coalesce(F.try_divide(F.col(m)[a].cast("double"), F.col(m)[b]) / d, F.lit(0.0)) for a, b, d in RULES.values()])


def base_failed(m: str) -> F.Column:
    return (F.col(m)["n_words"] < 50) | (100 * F.col(m)["n_repeat_words"] > 50 * F.col(m)["n_words"])


# --- exact binomial bounds -------------------------------------------------------------------


def upper_bound(k: int, n: int, alpha: float) -> float:
    """The largest rate under which k or fewer of n has a probability of alpha: the Clopper-Pearson bound."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p in (0.0, 1.0):
            break
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        if top + math.log(math.fsum(math.exp(t - top) for t in terms)) > math.log(alpha):
            low = p
        else:
            high = p
    return high


# --- proposing and certifying ----------------------------------------------------------------

Step = tuple[int, float]  # a rule's number and a cutoff


def path(counts: dict[Step, tuple[int, int]], gain: float = GAIN) -> list[Step]:
    """Steps in the order in which they are tested, from the (bad, good) documents each would reject: the fewest good ones for a bad one first."""
    out: list[Step] = []
    now = dict.fromkeys({r for r, _ in counts}, (math.inf, 0, 0))
    while True:
        best = None
        for (rule, cutoff), (bad, good) in counts.items():
            high, b, g = now[rule]
            more, lost = bad - b, good - g
            if cutoff < high and more > 0 and gain * lost <= more:
                key = (lost / more, -more, rule, -cutoff)
                best = min(best, (key, rule, cutoff)) if best else (key, rule, cutoff)
        if best is None:
            return out
        _, rule, cutoff = best
        now[rule] = (cutoff, *counts[rule, cutoff])
        out.append((rule, cutoff))


def last_certified(first: dict[int, int], n: int, steps: int, risk: float, alpha: float) -> int:
    """How many steps hold, from the number of good documents of n that each step is the first to reject."""
    k = held = 0
    for step in range(steps):
        k += first.get(step, 0)
        if n <= 0 or upper_bound(k, n, alpha) > risk:
            break
        held = step + 1
    return held


def small(table: DataFrame, strata: int) -> DataFrame:
    """A table with a row of some numbers for each stratum: sent to all tasks if it has at most 10,000 rows (some megabytes), so that no stratum has to meet in one."""
    return F.broadcast(table) if strata <= 10_000 else table


def calibrate(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[dict]:
    """holdout(stratum, good, proposes, stats) -> the certified cutoffs: stratum, rule, cutoff, n, rejected (by all rules of the stratum), bound.

    Only counts leave Spark: for each stratum one for each rule and candidate, and one for each step."""
    spark = holdout.sparkSession
    propose, certify = holdout.filter("proposes"), holdout.filter("not proposes and good")
    at = lambda r, good, q: F.percentile_approx(F.when(F.col("good") == F.lit(good), F.col("stats")[r]), list(q), 1000)
    quantiles = propose.groupBy("stratum").agg(*[F.concat(F.coalesce(at(r, True, GOOD_AT), F.expr("array()")), F.coalesce(at(r, False, BAD_AT), F.expr("array()"))).alias(f"q{r}") for r in range(len(RULES))])
    candidates = [(row["stratum"], [(r, c) for r in range(len(RULES)) for c in sorted({x for x in row[f"q{r}"] if x > 0})]) for row in quantiles.collect()]
    steps = "stratum string, steps array<struct<rule:int,cutoff:double>>"
    rejects = lambda s: F.get("stats", s["rule"]) >= s["cutoff"]
    met = propose.join(small(spark.createDataFrame(candidates, steps), len(candidates)), "stratum").select("stratum", "good", F.explode(F.filter("steps", rejects)).alias("s"))
    counts: dict[str, dict[Step, tuple[int, int]]] = {}
    for row in met.groupBy("stratum", "s").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("g")).collect():
        counts.setdefault(row["stratum"], {})[row["s"]["rule"], row["s"]["cutoff"]] = (row["bad"], row["g"])
    paths = {stratum: p for stratum, c in counts.items() if (p := path(c))}
    numbered = F.transform("steps", lambda s, i: F.when(rejects(s), i))
    tested = certify.join(small(spark.createDataFrame(list(paths.items()), steps), len(paths)), "stratum").select("stratum", F.array_min(F.array_compact(numbered)).alias("first"))
    first: dict[str, dict[int | None, int]] = {}
    for row in tested.groupBy("stratum", "first").count().collect():
        first.setdefault(row["stratum"], {})[row["first"]] = row["count"]
    out = []
    alpha, names = delta / max(1, len(candidates)), list(RULES)
    for stratum, found in sorted(first.items()):
        n, p = sum(found.values()), paths[stratum]
        held = last_certified(found, n, len(p), risk, alpha)
        rejected = sum(found.get(i, 0) for i in range(held))
        for rule, cutoff in dict(p[:held]).items():  # the lowest, as a rule's steps only go down
            out.append({"stratum": stratum, "rule": names[rule], "cutoff": cutoff, "n": n, "rejected": rejected, "bound": upper_bound(rejected, n, alpha)})
    return out


def stratum_of(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def cutoffs(rows: DataFrame, labels: DataFrame, m: str, stratum: str, risk: float, delta: float) -> DataFrame:
    """rows(doc_id, stratum, a struct of counts) -> over, high: for each stratum its certified cutoff of each rule, null for none."""
    spark = rows.sparkSession
    known = unused(rows, "id")[0]
    labelled = labels.filter("quality is not null").groupBy(F.col("doc_id").alias(known)).agg((F.max("quality") == 1).alias("good"))
    # any one row of a repeated doc_id
    once = rows.filter(~base_failed(m)).groupBy("doc_id").agg(F.min(F.struct(F.col(stratum).alias("stratum"), statistics(m).alias("stats"))).alias("x"))
    proposes = (F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(3)) == 0).alias("proposes")
    holdout = materialise(once.join(labelled, F.col("doc_id") == F.col(known)).select("x.stratum", "x.stats", "good", proposes))
    cuts: dict[str, list[float | None]] = {}
    for c in calibrate(holdout, risk, delta):
        cuts.setdefault(c["stratum"], [None] * len(RULES))[list(RULES).index(c["rule"])] = c["cutoff"]
    table = spark.createDataFrame(list(cuts.items()), "over string, high array<double>")
    return small(table, len(cuts))


def rejected_by(rows: DataFrame, cuts: DataFrame, m: str, stratum: str, name: str) -> DataFrame:
    """rows with the rules of their stratum that reject them."""
    over, high = unused(rows.withColumn(name, F.lit(0)), "over", "high")
    names = F.array(*map(F.lit, RULES))
    which = F.array_compact(F.transform(F.arrays_zip(statistics(m).alias("x"), F.col(high).alias("c"), names.alias("r")), lambda z: F.when(z["x"] >= z["c"], z["r"])))
    x = rows.join(cuts.toDF(over, high), F.col(stratum) == F.col(over), "left")
    return x.select(*rows.columns, F.coalesce(F.when(F.col(high).isNotNull(), which), F.expr("cast(array() as array<string>)")).alias(name))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs(doc_id, text, stratum) and labels(doc_id, quality) -> a row per document: doc_id, the counts, base_failed, kept, rejected_by.

    Every labelled document that passes the base rules is in the holdout: a third of them proposes and the
    others certify. A null stratum is a stratum of its own; one with too few labelled
    documents for any bound has the base rules alone, as has a table without labels. Strata are taken
    to be few: the driver gets some sixty counts for each. A null text has
    no words and fails. Labels that repeat a doc_id count once, and as good if any says so. Repeated
    documents and null doc_ids stay; other columns are ignored."""
    own = docs.select("doc_id", "text", stratum_of(stratum).alias("stratum"))
    rows = materialise(measured(own, ["doc_id", "stratum"], "m"))
    out = rejected_by(rows, cutoffs(rows, labels, "m", "stratum", risk, delta), "m", "stratum", "rejected_by")
    return out.select("doc_id", "m.*", base_failed("m").alias("base_failed"), (~base_failed("m") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that judge() keeps, with all their columns, those without a doc_id included.

    Texts are measured once for the cutoffs and again where they are kept or dropped, so none is shuffled or written on the way."""
    own = docs.select("doc_id", "text", stratum_of(stratum).alias("stratum"))
    cuts = cutoffs(materialise(measured(own, ["doc_id", "stratum"], "m")), labels, "m", "stratum", risk, delta)
    m, s, rejected = unused(docs, "measures", "stratum", "rejected_by")
    rows = measured(docs.withColumn(s, stratum_of(stratum)), [*docs.columns, s], m)
    out = rejected_by(rows.filter(~base_failed(m)), cuts, m, s, rejected)
    return out.filter(F.size(rejected) == 0).select(*docs.columns)
