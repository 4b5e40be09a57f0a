"""Detector evaluation: confusion counts, intervals, ranking metrics, slices, ablation and robustness.

Ranking metrics first group by score, so the windows run over distinct scores and not over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions.text import round_half_up as r6
from lexiscope.operators.ordering import running
from lexiscope.session import materialise

Z = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    return r6(F.try_divide(a.cast("double"), b))


def counts(expected: str | Column = "expected", predicted: str | Column = "predicted") -> list[Column]:
    e, p = (F.col(c) if isinstance(c, str) else c for c in (expected, predicted))
    return [F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn")]


def with_metrics(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "n": tp + fp + fn + tn, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp),
    })


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df(expected, predicted, by) -> by, tp, fp, fn, tn, n and six rates; a rate without a base is null."""
    return with_metrics(df.groupBy(*(by or [])).agg(*counts()))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of k of n; null for n = 0."""
    p = k / n
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    base = 1 + Z * Z / n
    ok = n > 0
    return F.when(ok, r6(F.greatest(F.lit(0.0), (centre - spread) / base))), F.when(ok, r6(F.least(F.lit(1.0), (centre + spread) / base)))


def with_interval(df: DataFrame, k: str, n: str, name: str) -> DataFrame:
    low, high = wilson(F.col(k).cast("double"), F.col(n).cast("double"))
    return df.withColumns({f"{name}_low": low, f"{name}_high": high})


def slices(df: DataFrame, dims: list[str], least: int = 5) -> DataFrame:
    """One row for each value of each dimension: dim, value, confusion, status; missing values are `unspecified`."""
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.nullif(F.trim(F.col(d).cast("string")), F.lit("")), F.lit("unspecified")).alias("value")) for d in dims])
    rows = df.select("expected", "predicted", F.inline(cells))
    return confusion(rows, ["dim", "value"]).withColumn("status", F.when(F.col("n") < least, "insufficient-data").otherwise("ok"))


def resolve(df: DataFrame, field: str, aliases: list[str], default: Column) -> DataFrame:
    """A slice field from the first of its aliases that isn't blank, else the default of the row's class."""
    given = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in [field, *aliases] if a in df.columns]
    return df.withColumn(field, F.coalesce(*given, default))


def unpivot(df: DataFrame, keys: list[str], signals: list[str], name: str = "signal", value: str = "fired") -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias(name), F.col(s).alias(value)) for s in signals])))


def detector_metrics(df: DataFrame, signals: list[str]) -> DataFrame:
    return confusion(unpivot(df, ["expected"], signals, "detector", "predicted"), ["detector"])


def catch_rates(df: DataFrame, family: str) -> DataFrame:
    """Catch rate of positives by (lang, family) and false-positive rate of negatives by lang, with intervals."""
    hit = df.filter("expected").groupBy("lang", F.col(family).alias("family")).agg(F.count_if("predicted").alias("k"), F.count("*").alias("n")).withColumn("kind", F.lit("catch"))
    false = df.filter("not expected").groupBy("lang").agg(F.count_if("predicted").alias("k"), F.count("*").alias("n")).withColumns({"kind": F.lit("false_positive"), "family": F.lit(None).cast("string")})
    both = hit.unionByName(false).withColumn("rate", ratio(F.col("k"), F.col("n")))
    return with_interval(both, "k", "n", "rate")


def claim_gate(df: DataFrame, family: str, least: int = 100, langs: int = 2, families: int = 3) -> DataFrame:
    """Whether a claim may be made: enough full cells, languages and families, and no open outcome; else what blocks it."""
    cells = df.groupBy("lang", F.col(family).alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNull()).alias("open"))
    full = F.col("n") >= least
    out = cells.agg(F.count_if(full).alias("cells"), F.count_distinct(F.when(full, F.col("lang"))).alias("langs"), F.count_distinct(F.when(full, F.col("family"))).alias("families"), F.sum("open").alias("open"))
    blockers = F.array_compact(F.array(F.when(F.col("langs") < langs, "languages"), F.when(F.col("families") < families, "families"), F.when(F.col("open") > 0, "outcomes")))
    return out.withColumn("blockers", F.array_join(blockers, ",")).withColumn("ok", F.col("blockers") == "")


# --- ranking ---------------------------------------------------------------------------------


def by_score(df: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg, rows of every distinct score, written once: what is made of them reads them several times, and the scores may be dear."""
    return materialise(df.groupBy(*by, "score").agg(F.count_if("expected").alias("pos"), F.count_if(~F.col("expected")).alias("neg"), F.count("*").alias("rows")))


def threshold_sweep(df: DataFrame, by: list[str] | None = None, points: DataFrame | None = None) -> DataFrame:
    """by, threshold, tp, fp, fn, tn and rates at every score, and at 0 and 101. points of by_score() may be given."""
    by = by or []
    points = (by_score(df, by) if points is None else points).select(*by, "score", "pos", "neg")
    ends = points.select(*by).distinct() if by else df.sparkSession.range(1).select()
    ends = ends.withColumn("score", F.explode(F.array(F.lit(0.0), F.lit(101.0)))).withColumns({"pos": F.lit(0).cast("long"), "neg": F.lit(0).cast("long")})
    points = points.unionByName(ends).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = points.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    x = running(points, by, "score", {"tp0": F.col("pos"), "fp0": F.col("neg")}, descending=True)
    x = x.join(whole, by) if by else x.crossJoin(F.broadcast(whole))  # one row
    out = x.select(*by, F.col("score").alias("threshold"), (F.col("tp0") + F.col("pos")).alias("tp"), (F.col("fp0") + F.col("neg")).alias("fp"), "p", "q")
    return with_metrics(out.select(*by, "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn")))


def best_f1(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold of the best F1; ties: precision, recall, then the lower false-positive rate, then the higher threshold."""
    # the greatest of (f1, precision, recall, -fpr, threshold), by partial aggregation; nulls come last
    rank = F.struct(*[F.coalesce(c, F.lit(float("-inf"))) for c in (F.col("f1"), F.col("precision"), F.col("recall"), -F.col("fpr"), F.col("threshold"))])
    return sweep.groupBy(*(by or [])).agg(F.max_by(F.struct(*[c for c in sweep.columns if c not in (by or [])]), rank).alias("x")).select(*(by or []), "x.*").select(*sweep.columns)


def roc_auc(df: DataFrame | None, by: list[str] | None = None, points: DataFrame | None = None) -> DataFrame:
    """by, pos, neg, auc: mid-rank form, a tie counts half; null without both classes. points(by, score, pos, neg) may be given instead of rows."""
    by = by or []
    points = running(by_score(df, by) if points is None else points, by, "score", {"under": F.col("neg")})
    out = points.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (2 * F.col("under") + F.col("neg"))).alias("u2"))
    return out.select(*by, "pos", "neg", r6(F.try_divide(F.col("u2").cast("double"), 2.0 * F.col("pos") * F.col("neg"))).alias("auc"))


def average_precision(df: DataFrame, by: list[str] | None = None, points: DataFrame | None = None) -> DataFrame:
    """by, ap: the precision at each score, weighted by the recall that it adds."""
    by = by or []
    x = running(by_score(df, by) if points is None else points, by, "score", {"tp0": F.col("pos"), "all0": F.col("pos") + F.col("neg")}, descending=True)
    points = x.withColumns({"tp": F.col("tp0") + F.col("pos"), "all": F.col("all0") + F.col("pos") + F.col("neg")})
    return points.groupBy(*by).agg(r6(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("all")), F.sum("pos"))).alias("ap"))


def tpr_at_fpr(df: DataFrame, targets: list[float], by: list[str] | None = None) -> DataFrame:
    """by, target, budget, threshold, tpr, fpr: the most true positives with at most floor(target x negatives) false ones; ties: fewer false positives, then the higher threshold."""
    by = by or []
    sweep = threshold_sweep(df, by).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    sweep = sweep.withColumn("budget", F.floor(F.col("target") * (F.col("fp") + F.col("tn")) + 1e-9))
    w = Window.partitionBy(*by, "target").orderBy(F.col("tp").desc(), "fp", F.col("threshold").desc())
    ok = sweep.filter("fp <= budget").withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return ok.select(*by, "target", "budget", "threshold", F.col("recall").alias("tpr"), "fpr")


def low_fpr_report(df: DataFrame, targets: list[float], family: str, least: int = 20) -> DataFrame:
    """tpr_at_fpr by language and by language and register, with a status for thin cells."""
    cells = df.select("score", "expected", F.inline(F.array(F.struct(F.lit("lang").alias("level"), F.col("lang").alias("cell")), F.struct(F.lit("lang_register").alias("level"), F.concat_ws("/", "lang", family).alias("cell")))))
    sizes = cells.groupBy("level", "cell").agg(F.count_if("expected").alias("pos"), F.count_if(~F.col("expected")).alias("neg"))
    out = tpr_at_fpr(cells, targets, ["level", "cell"]).join(sizes, ["level", "cell"])
    return out.withColumn("status", F.when((F.col("pos") == 0) | (F.col("neg") == 0), "one-class").when(F.col("pos") + F.col("neg") < least, "thin").otherwise("ok"))


def ranking_summary(df: DataFrame) -> DataFrame:
    """One row: range of the scores, AUC, average precision, best F1 and its threshold."""
    points = by_score(df, [])
    span = points.agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    best = best_f1(threshold_sweep(df, points=points)).select(F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    # each side is one row
    return span.crossJoin(roc_auc(df, points=points)).crossJoin(average_precision(df, points=points)).crossJoin(best)


# --- comparison ------------------------------------------------------------------------------


def ablation(df: DataFrame, signals: list[str]) -> DataFrame:
    """For each signal left out: hits that only it made, and the change of precision and recall."""
    any_of = lambda names: F.greatest(*[F.col(s).cast("int") for s in names], F.lit(0)) == 1
    rows = df.select("expected", any_of(signals).alias("full"), F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), any_of([x for x in signals if x != s]).alias("rest")) for s in signals])))
    alone = F.col("full") & ~F.col("rest")
    g = rows.groupBy("signal").agg(F.count_if(alone & F.col("expected")).alias("only_tp"), F.count_if(alone & ~F.col("expected")).alias("only_fp"), *[c.alias(f"f_{n}") for c, n in zip(counts("expected", "full"), ("tp", "fp", "fn", "tn"), strict=True)], *[c.alias(f"r_{n}") for c, n in zip(counts("expected", "rest"), ("tp", "fp", "fn", "tn"), strict=True)])
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return g.select("signal", "only_tp", "only_fp", r6(d("r_tp", "r_fp") - d("f_tp", "f_fp")).alias("precision_delta"), r6(d("r_tp", "r_fn") - d("f_tp", "f_fn")).alias("recall_delta"))


def candidate_eval(df: DataFrame, candidates: list[str], guarded: Column) -> DataFrame:
    """Would a new signal add more true than false positives, and none in the guarded slice?"""
    rows = unpivot(df.withColumn("guarded", guarded), ["expected", "predicted", "guarded"], candidates, "candidate")
    new = F.col("fired") & ~F.col("predicted")
    g = rows.groupBy("candidate").agg(F.count_if("fired").alias("fires"), F.count_if(new & F.col("expected")).alias("add_tp"), F.count_if(new & ~F.col("expected")).alias("add_fp"), F.count_if(new & ~F.col("expected") & F.col("guarded")).alias("guarded_fp"))
    return g.withColumn("decision", F.when((F.col("add_tp") > F.col("add_fp")) & (F.col("guarded_fp") == 0), "PROMOTE").otherwise("HOLD"))


def robustness(df: DataFrame, by: str = "lang") -> DataFrame:
    """df(transform, by, expected, before, after) -> decisions kept on each side, and how many changed."""
    return df.groupBy("transform", by).agg(
        F.count_if(F.col("before") & F.col("expected")).alias("caught"), F.count_if(F.col("before") & F.col("after") & F.col("expected")).alias("still_caught"),
        F.count_if(~F.col("before") & ~F.col("expected")).alias("clean"), F.count_if(~F.col("before") & ~F.col("after") & ~F.col("expected")).alias("still_clean"), F.count_if(F.col("before") != F.col("after")).alias("changed"),
    ).withColumns({"detection_kept": ratio(F.col("still_caught"), F.col("caught")), "clean_kept": ratio(F.col("still_clean"), F.col("clean"))})


def mode_comparison(df: DataFrame, modes: list[str]) -> DataFrame:
    """One row: recall and false-positive rate of each mode, and their change from mode to mode."""
    m = confusion(unpivot(df, ["expected"], modes, "mode", "predicted"), ["mode"])
    wide = m.groupBy().pivot("mode", modes).agg(F.first("recall").alias("recall"), F.first("fpr").alias("fpr"))
    deltas = [r6(F.col(f"{b}_{x}") - F.col(f"{a}_{x}")).alias(f"{b}_{x}_delta") for a, b in zip(modes, modes[1:], strict=False) for x in ("recall", "fpr")]
    return wide.select("*", *deltas)


def corpus_baseline(df: DataFrame, expected: DataFrame, signals: list[str], by: str) -> DataFrame:
    """Rows and fires of each signal by slice, against the counts expected of the slice: drift is their difference."""
    got = df.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(s).alias(f"fires_{s}") for s in signals])
    return got.join(expected, by, "full").withColumn("drift", F.coalesce("n", F.lit(0)) - F.coalesce("expected_n", F.lit(0)))


def make_ranges(df: DataFrame, value: str, by: str, tolerance: float) -> DataFrame:
    return df.groupBy(by).agg(r6(F.min(value) - tolerance).alias("low"), r6(F.max(value) + tolerance).alias("high"))


def check_ranges(df: DataFrame, ranges: DataFrame, value: str, by: str) -> DataFrame:
    """Rows of each group outside its range; a group without a range fails as a whole."""
    j = df.join(ranges, by, "left")
    out = F.coalesce((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")), F.lit(True))
    return j.groupBy(by).agg(F.count("*").alias("n"), F.count_if(out).alias("outside"))


def detector_comparison(fixtures: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics of outside detectors over the fixtures they label, with their coverage; unknown ids are counted apart."""
    total = fixtures.agg(F.count("*").alias("total"))
    known = labels.join(fixtures.select("doc_id", "expected"), "doc_id", "left")
    m = with_metrics(known.filter("expected is not null").groupBy("detector").agg(*counts()))
    lost = known.groupBy("detector").agg(F.count_if(F.col("expected").isNull()).alias("unknown"))
    return m.join(lost, "detector").crossJoin(total).withColumn("coverage", ratio(F.col("n"), F.col("total")))


def latency_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nearest-rank percentiles, mean and rate per second of durations in milliseconds."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    g = df.groupBy(*by).agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(value).alias("m"))
    return g.select(*by, "n", "p50", "p95", "p99", r6(F.col("m"), 4).alias("mean"), r6(F.try_divide(F.lit(1000.0), F.col("m")), 4).alias("per_second"))


def usage_totals(df: DataFrame, by: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """Sums of usage fields under their several names; a total stays null until a value is seen."""
    return df.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(*[F.col(a) for a in names])).alias(f) for f, names in fields.items()])


def usage_charges(df: DataFrame, prices: DataFrame, grain: int) -> DataFrame:
    """df(kind, account, amount), prices(kind, price): charges per account, whole grains rounded up."""
    grains = F.ceil(F.col("amount") / F.lit(grain))
    return df.join(prices, "kind").groupBy("account").agg(F.count("*").alias("lines"), F.sum(grains).alias("grains"), F.sum(grains * F.col("price")).alias("charge"))
