"""Study statistics over long tables, in closed forms that need no pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions.text import round_half_up as r6
from lexiscope.operators.evaluation import roc_auc
from lexiscope.operators.ordering import running


#: Cumulative shares of a Poisson distribution of mean 1.
STEPS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
GRAIN = 1 << 40


def weights(key: str, iterations: int, seed: int) -> Column:
    """How often a row is drawn in each replicate, from a hash of (row key, replicate, seed): no row is moved, and runs repeat."""

    def weight(b: Column) -> Column:
        x = F.pmod(F.xxhash64(F.col(key), b, F.lit(seed)), F.lit(GRAIN)) / F.lit(float(GRAIN))
        return sum(((x >= s).cast("int") for s in STEPS), F.lit(0))

    return F.transform(F.sequence(F.lit(1), F.lit(iterations)), weight)


def drawn_sums(df: DataFrame, by: list[str], key: str, iterations: int, seed: int, values: dict[str, Column]) -> DataFrame:
    """by and, for each name, one array with the sum of its column times the weight of the row, replicate by replicate.

    A row keeps its place and is never copied: its weights are one array, and tasks send one row for each group."""
    w, names = "_" * (1 + max(map(len, df.columns))) + "w", list(values)  # longer than any name there is
    x = df.select(*by, *[v.alias(f"{w}_{n}") for n, v in values.items()], weights(key, iterations, seed).alias(w))
    sums = [F.sum(F.get(w, F.lit(i)) * F.col(f"{w}_{n}")).alias(f"{w}_{n}_{i}") for n in names for i in range(iterations)]
    return x.groupBy(*by).agg(*sums).select(*by, *[F.array(*[F.col(f"{w}_{n}_{i}") for i in range(iterations)]).alias(n) for n in names])


def interval(values: str | Column) -> list[Column]:
    """low, high: the 95 % percentile interval of an array of replicates' values; those that are null don't count."""
    sorted_ = F.array_sort(F.array_compact(values))
    n = F.size(sorted_)
    rank = lambda q: F.get(sorted_, F.least(F.floor(n * F.lit(q)).cast("int"), n - 1))
    return [rank(0.025).alias("low"), rank(0.975).alias("high")]


def bootstrap_ci(df: DataFrame, value: str, iterations: int = 200, seed: int = 7, by: list[str] | None = None, key: str = "id") -> DataFrame:
    """by, n, mean, low, high: the 95 % percentile interval of the mean under a Poisson bootstrap."""
    by, there = by or [], F.col(value).isNotNull()
    sums = drawn_sums(df, by, key, iterations, seed, {"s": F.col(value).cast("double"), "n": there.cast("int")})
    ci = sums.select(*by, F.zip_with("s", "n", lambda s, n: F.try_divide(s, n)).alias("m")).select(*by, *interval("m"))
    base = df.groupBy(*by).agg(F.count_if(there).alias("n"), F.avg(value).alias("mean"))
    if not by:
        return base.crossJoin(ci)
    same = ci.select(*[F.col(c).alias(f"{c} of ci") for c in by], "low", "high")
    return base.join(same, [F.col(c).eqNullSafe(F.col(f"{c} of ci")) for c in by]).select(*by, "n", "mean", "low", "high")


def bootstrap_auc_ci(df: DataFrame, by: list[str], iterations: int = 200, seed: int = 11, key: str = "id") -> DataFrame:
    """df(by, key, score, expected) -> by, low, high: the 95 % percentile interval of the AUC under a Poisson bootstrap.

    A distinct score has one vector of drawn positives and one of negatives. Scores are dealt out by ranges; a range
    adds up its own pairs for all replicates and its totals, and the ranges of a group, a row for each, are put together."""
    one = lambda on: F.coalesce(on, F.lit(False)).cast("int")
    points = drawn_sums(df.filter(F.col("score").isNotNull()), [*by, "score"], key, iterations, seed, {"pos": one(F.col("expected")), "neg": one(~F.col("expected"))})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*by).schema)
    head = f"{kinds}, " if by else ""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of (by, score) -> for each run of a group: its drawn positives, negatives, and pairs won twice over."""
        held, out, schema = None, [], None
        for b in batches:
            groups = list(zip(*[b.column(c).to_pylist() for c in range(len(by))], strict=True)) if by else [()] * b.num_rows
            pos, neg = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, iterations) for c in ("pos", "neg"))
            schema = b.schema
            for g, p, q in zip(groups, pos, neg, strict=True):
                if held is None or held[0] != g:
                    if held is not None:
                        out.append(held)
                    held = [g, np.zeros(iterations), np.zeros(iterations), np.zeros(iterations)]
                held[3] += p * (2 * held[2] + q)
                held[1] += p
                held[2] += q
        if held is not None:
            out.append(held)
        if schema is not None:
            from pyspark import TaskContext

            own = TaskContext.get().partitionId()
            columns = [pa.array([o[0][c] for o in out], schema.field(c).type) for c in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([own] * len(out), pa.int32()), *[pa.array([o[k].tolist() for o in out], pa.list_(pa.float64())) for k in (1, 2, 3)]], [*by, "part", "pos", "neg", "won"])

    parts = points.repartitionByRange(*by, "score").sortWithinPartitions(*by, "score").mapInArrow(ranges, f"{head}part int, pos array<double>, neg array<double>, won array<double>")
    folded = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part", "pos", "neg", "won"))).alias("r"))  # a row for each range
    zero = F.array_repeat(F.lit(0.0), iterations)
    start = F.struct(zero.alias("pos"), zero.alias("neg"), zero.alias("won"))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def put(a: Column, x: Column) -> Column:
        across = F.zip_with(x["pos"], a["neg"], lambda p, n: 2 * p * n)
        return F.struct(plus(a["pos"], x["pos"]).alias("pos"), plus(a["neg"], x["neg"]).alias("neg"), plus(plus(a["won"], x["won"]), across).alias("won"))

    whole = folded.select(*by, F.aggregate("r", start, put).alias("t"))
    pairs = F.zip_with("t.pos", "t.neg", lambda p, n: 2 * p * n)
    auc = F.zip_with("t.won", pairs, lambda w, n: r6(F.try_divide(w, n)))
    return whole.select(*by, auc.alias("auc")).select(*by, *interval("auc"))


def krippendorff(df: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: units, ratings, alpha (interval). Units with one rating are left out; null under two units or without spread."""
    u = df.filter(F.col(value).isNotNull()).groupBy(unit).agg(F.count("*").alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).filter("m >= 2")
    a = u.agg(F.count("*").alias("units"), F.sum("m").alias("ratings"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n = F.col("ratings")
    observed, chance = F.col("d") / n, 2 * (n * F.col("q") - F.col("s") * F.col("s")) / (n * (n - 1))
    return a.select("units", "ratings", F.when((F.col("units") >= 2) & (chance != 0), r6(1 - observed / chance, 5)).alias("alpha"))


def mid_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """by, value, name: the average rank of each distinct value, from counts of values."""
    points = df.groupBy(*by, value).agg(F.count("*").alias("__c"))
    return running(points, by, value, {"__before": F.col("__c")}).select(*by, value, (F.col("__before") + (F.col("__c") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho with average ranks; null without spread."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = rows.join(mid_ranks(rows, x, by, "rx"), [*by, x]).join(mid_ranks(rows, y, by, "ry"), [*by, y])
    return r.groupBy(*by).agg(F.count("*").alias("n"), r6(F.corr("rx", "ry"), 5).alias("rho"))


def cliffs_delta(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df(score, expected): 2 AUC - 1."""
    by = by or []
    return roc_auc(df, by).select(*by, "pos", "neg", r6(2 * F.col("auc") - 1, 5).alias("delta"))


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Adds u, the vector scaled to length one (zeros stay zeros), and whether it had a length."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("__n", norm).withColumns({"has": F.col("__n") > 0, "u": F.transform(vector, lambda x: F.when(F.col("__n") > 0, x.cast("double") / F.col("__n")).otherwise(0.0))}).drop("__n")


def cohesion(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """by, n, cohesion: the mean cosine over all pairs, from the length of the sum of the unit vectors."""
    rows = unit_vectors(df, vector).select(*by, "has", F.posexplode("u").alias("i", "x"))
    sums = rows.groupBy(*by, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.count_if("has").alias("k"))
    out = sums.groupBy(*by).agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return out.select(*by, "n", F.when(F.col("n") >= 2, r6((F.col("q") - F.col("k")) / (F.col("n") * (F.col("n") - 1)), 5)).alias("cohesion"))


def cohesion_test(df: DataFrame, vector: str, group: Column, key: str, iterations: int = 50, seed: int = 3) -> DataFrame:
    """One row: cohesion inside and outside the group, their gap, and the share of seeded permutations with a gap as large.

    In a replicate each row is drawn by its own hash, with a chance of the group's share of all rows. So draws
    need no ranking and no join: a row adds its vector to the sums of the replicates it is drawn in, and
    the outside is the total less the inside."""
    base = unit_vectors(df, vector).select(F.col(key).alias("k"), F.coalesce(group, F.lit(False)).alias("g"), "has", "u")
    size = base.agg(F.count("*").alias("rows"), F.count_if("has").alias("longs"), F.avg(F.col("g").cast("double")).alias("share")).first()
    chance = int((size["share"] or 0.0) * GRAIN)
    drawn = lambda rep: F.when(rep == 0, F.col("g")).otherwise(F.pmod(F.xxhash64(F.col("k"), rep, F.lit(seed)), F.lit(GRAIN)) < chance)
    reps = F.explode(F.filter(F.sequence(F.lit(0), F.lit(iterations)), drawn))
    inside = base.select("has", "u", reps.alias("rep")).select("rep", "has", F.posexplode("u").alias("i", "x")).groupBy("rep", "i").agg(F.sum("x").alias("s"), F.count_if("has").alias("kin"), F.count("*").alias("nin"))
    total = base.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("t"))
    q = inside.join(total, "i").groupBy("rep").agg(F.sum(F.col("s") * F.col("s")).alias("qi"), F.sum((F.col("t") - F.col("s")) * (F.col("t") - F.col("s"))).alias("qo"), F.max("kin").alias("kin"), F.max("nin").alias("nin"))
    mean = lambda q2, has, n: F.when(n >= 2, r6((q2 - has) / (n * (n - 1)), 5))
    every = q.select("rep", mean(F.col("qi"), F.col("kin"), F.col("nin")).alias("inside"), mean(F.col("qo"), size["longs"] - F.col("kin"), size["rows"] - F.col("nin")).alias("outside")).withColumn("gap", F.col("inside") - F.col("outside"))
    real = every.filter("rep = 0").select("inside", "outside", "gap")
    return every.filter("rep > 0").select(F.col("gap").alias("other")).crossJoin(F.broadcast(real)).groupBy("inside", "outside", "gap").agg(((F.count_if(F.col("other") >= F.col("gap")) + 1) / (F.count("*") + 1)).alias("p"))


def panel_score(df: DataFrame, item: str, judge: str, value: str, quorum: int = 2) -> DataFrame:
    """item, judges, score: the mean over judges of their means; null below the quorum."""
    j = df.filter(F.col(value).isNotNull()).groupBy(item, judge).agg(F.avg(value).alias("v"))
    return j.groupBy(item).agg(F.count("*").alias("judges"), F.avg("v").alias("m")).select(item, "judges", F.when(F.col("judges") >= quorum, r6(F.col("m"), 4)).alias("score"))


def efficacy(df: DataFrame, by: list[str]) -> DataFrame:
    """df(before, after): means, mean change and the share that fell."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), r6(F.avg("before"), 4).alias("before"), r6(F.avg("after"), 4).alias("after"), r6(F.avg(F.col("after") - F.col("before")), 4).alias("delta"), r6(F.avg((F.col("after") < F.col("before")).cast("double")), 4).alias("fell"))


def agreement(df: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """Two judges' scores of the same items: alpha, rho and mean absolute gap, in one row."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(item, a, b)
    long = both.select(item, F.explode(F.array(a, b)).alias("v"))
    gap = both.agg(r6(F.avg(F.abs(F.col(a) - F.col(b))), 4).alias("mean_gap"))
    return krippendorff(long, item, "v").crossJoin(spearman(both, a, b, []).select("n", "rho")).crossJoin(gap)


def paired_study(df: DataFrame, quorum: int = 2, least: float = 5.0, iterations: int = 200, seed: int = 5) -> DataFrame:
    """df(item, class, before, before_judges, after, after_judges) -> for each class: pairs with a quorum on both sides, what was lost, the mean paired change with its bootstrap interval, and the decision.

    Of class `ai` the change is supported if its interval lies below 0 and its mean is at most -least, else rejected;
    for other classes it is a guard against over-editing: violated if the interval lies above 0, else held."""
    ok = (F.col("before_judges") >= quorum) & (F.col("after_judges") >= quorum)
    x = df.withColumn("delta", F.when(F.coalesce(ok, F.lit(False)), F.col("after") - F.col("before")))
    out = x.groupBy("class").agg(F.count("delta").alias("pairs"), (F.count("*") - F.count("delta")).alias("lost"), r6(F.avg("delta"), 4).alias("delta"))
    ci = bootstrap_ci(x.filter("delta is not null"), "delta", iterations, seed, ["class"], "item").select("class", r6(F.col("low"), 4).alias("low"), r6(F.col("high"), 4).alias("high"))
    ai = F.when((F.col("high") < 0) & (F.col("delta") <= -least), "supported").otherwise("rejected")
    decision = F.when(F.col("pairs") == 0, "no-data").when(F.col("class") == "ai", ai).otherwise(F.when(F.col("low") > 0, "violated").otherwise("held"))
    return out.join(ci, "class", "left").withColumn("decision", decision)


def classify_cues(df: DataFrame, text: str, rubric: list[tuple[str, str]], default: str = "other") -> DataFrame:
    """cue, n, share: the first pattern of the rubric that matches names the cue."""
    cue = F.coalesce(*[F.when(F.lower(text).rlike(p), c) for c, p in rubric], F.lit(default))
    g = df.groupBy(cue.alias("cue")).agg(F.count("*").alias("n"))
    return g.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 5))


def judge_calibration(df: DataFrame, repeats: int = 5, iterations: int = 200, seed: int = 11) -> DataFrame:
    """df(judge, judge_family, item, repeat, score, called, expected, family) -> for each judge, over first judgements of texts that its own family did not write: n, accuracy of its
    calls, AUC with its bootstrap interval, mean scores of both classes; the median spread of an item's repeats; how much higher it scores its own family's texts; and the verdict.

    PASS: an AUC of 0.75 or more and a spread of at most 12; DEMOTE: an AUC under 0.65 or a spread over 20; else WATCH."""
    first = df.filter("repeat = 0")
    own = F.col("family") == F.col("judge_family")
    cross = first.filter(~F.col("expected") | ~F.coalesce(own, F.lit(False)))
    mean = lambda on: F.avg(F.when(on, F.col("score")))
    base = cross.groupBy("judge").agg(F.count("*").alias("n"), r6(F.avg((F.col("called") == F.col("expected")).cast("double")), 5).alias("accuracy"), r6(mean(~F.col("expected")), 4).alias("bias_human"), r6(mean(F.col("expected")), 4).alias("bias_ai"))
    mine = first.filter(F.col("expected") & own).groupBy("judge").agg(F.avg("score").alias("own"))
    spread = df.groupBy("judge", "item").agg(F.count("*").alias("k"), F.stddev_samp("score").alias("sd")).filter(F.col("k") >= repeats).groupBy("judge").agg(r6(F.median("sd"), 4).alias("repeat_sd"))
    ci = bootstrap_auc_ci(cross, ["judge"], iterations, seed, "item").select("judge", F.col("low").alias("auc_low"), F.col("high").alias("auc_high"))
    x = base.join(roc_auc(cross, ["judge"]).select("judge", "auc"), "judge").join(ci, "judge", "left").join(spread, "judge", "left").join(mine, "judge", "left")
    verdict = F.when((F.col("auc") < 0.65) | (F.col("repeat_sd") > 20), "DEMOTE").when((F.col("auc") >= 0.75) & (F.col("repeat_sd") <= 12), "PASS").otherwise("WATCH")
    return x.select("judge", "n", "accuracy", "auc", "auc_low", "auc_high", "bias_human", "bias_ai", "repeat_sd", r6(F.col("own") - F.col("bias_ai"), 4).alias("self_preference"), verdict.alias("verdict"))


def merge_repeats(df: DataFrame, item: str, value: str, status: str, order: list[str]) -> DataFrame:
    """item, n, median, spread, worst: the worst status is the last one of `order` that occurs."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    return df.groupBy(item).agg(F.count("*").alias("n"), r6(F.median(value), 4).alias("median"), r6(F.max(value) - F.min(value), 4).alias("spread"), F.max_by(status, rank).alias("worst"))
