"""Bootstrap intervals against numpy, replicate by replicate, with the weights that Spark draws."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.operators import stats as X


def half_up(x):
    return np.floor(x * 1e6 + 0.5) / 1e6


def percentile(values):
    v = np.sort(values[~np.isnan(values)])
    at = lambda q: v[min(int(len(v) * q), len(v) - 1)]
    return at(0.025), at(0.975)


def rows(spark, n=300):
    rng = random.Random(4)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([0.0, 0.5, 2.0, rng.random() * 3]), rng.random() < 0.4) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, g string, score double, expected boolean")


def drawn(df, iterations, seed):
    return {r["id"]: np.array(r["w"]) for r in df.select("id", X.weights("id", iterations, seed).alias("w")).collect()}


def test_intervals_of_means(spark):
    data, df = rows(spark)
    w = drawn(df, 100, 7)
    got = {r["g"]: (r["n"], r["low"], r["high"]) for r in X.bootstrap_ci(df, "score", 100, 7, ["g"]).collect()}
    for g in ("a", "b", None):
        own = [(w[i], v) for i, name, v, _ in data if name == g]
        low, high = percentile(sum(x * v for x, v in own) / sum(x for x, _ in own))
        assert got[g][0] == len(own) and got[g][1:] == pytest.approx((low, high))
    whole = X.bootstrap_ci(df, "score", 100, 7).first()
    assert (whole["low"], whole["high"]) == pytest.approx(percentile(sum(w[i] * v for i, _, v, _ in data) / sum(w.values())))


@pytest.mark.parametrize("by", [["g"], []])
def test_intervals_of_auc(spark, by):
    data, df = rows(spark)
    df = df.filter("g is not null")
    w = drawn(df, 60, 11)
    out = X.bootstrap_auc_ci(df, by, 60, 11).collect()
    got = {r["g"] if by else "all": (r["low"], r["high"]) for r in out}
    for g in ("a", "b") if by else ("all",):
        own = [(w[i], v, e) for i, name, v, e in data if name is not None and g in (name, "all")]
        won = sum(p * q * (2.0 if v > u else 1.0 if v == u else 0.0) for p, v, e in own if e for q, u, f in own if not f)
        pairs = 2.0 * sum(p for p, _, e in own if e) * sum(q for q, _, f in own if not f)
        assert got[g] == pytest.approx(percentile(half_up(won / pairs)), abs=2e-6)


def test_what_is_shuffled_is_no_more_than_distinct_scores(spark):
    """A row for each distinct score and task at most, however many replicates there are."""
    data, df = rows(spark)
    points = X.drawn_sums(df, ["score"], "id", 50, 1, {"pos": F.col("expected").cast("int")})
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and points.count() == len({r[2] for r in data})


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, g string, score double, expected boolean")
    assert X.bootstrap_ci(none, "score", 20, 1, ["g"]).count() == 0 and X.bootstrap_auc_ci(none, ["g"], 20).count() == 0
    one = spark.createDataFrame([(1, "a", 1.0, True)], none.schema)
    assert X.bootstrap_auc_ci(one, ["g"], 20).first()["low"] is None
