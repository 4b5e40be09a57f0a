"""The structural classifier: scaler, training, scoring with given weights, thresholds and verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import round_half_up as r6
from lexiscope.operators.ordering import running
from lexiscope.session import materialise
from lexiscope.operators.style import FEATURES


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float
    mu: tuple[float, ...]
    sigma: tuple[float, ...]
    threshold: float
    lang: str | None = None

    def __post_init__(self):
        if not len(self.weights) == len(self.mu) == len(self.sigma) == len(FEATURES):
            raise ValueError(f"a model has {len(FEATURES)} weights, means and deviations")
        if not 0 <= self.threshold <= 1 or any(s <= 0 for s in self.sigma):
            raise ValueError("the threshold is a share and deviations are positive")


def fit_scaler(df: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature, mu, sigma: population deviation, 1 where it is 0."""
    g = df.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    sigma = lambda n: F.when(r6(F.col(f"s_{n}"), 5) > 0, F.col(f"s_{n}")).otherwise(1.0)
    return g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), r6(F.col(f"m_{n}"), 5).alias("mu"), r6(sigma(n), 5).alias("sigma")) for n in names])))


def train(df: DataFrame, label: str, reg: float = 0.01, names: tuple[str, ...] = FEATURES, threshold: float = 0.5) -> Model:
    """L2 logistic regression over scaled features by Spark ML; the model comes back as plain numbers."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    scale = {r["feature"]: (r["mu"], r["sigma"]) for r in fit_scaler(df, names).collect()}
    x = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(*[(F.col(n) - scale[n][0]) / scale[n][1] for n in names])).alias("features"))
    m = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=200).fit(x)
    return Model(tuple(m.coefficients.toArray().tolist()), float(m.intercept), tuple(scale[n][0] for n in names), tuple(scale[n][1] for n in names), threshold)


def predict(model: Model, names: tuple[str, ...] = FEATURES) -> Column:
    """Sigmoid of the weighted scaled features."""
    z = sum((F.lit(w) * (F.col(n) - m) / s for n, w, m, s in zip(names, model.weights, model.mu, model.sigma, strict=True)), F.lit(model.bias))
    return 1 / (1 + F.exp(-z))


def threshold_for_fpr(df: DataFrame, share: float, by: list[str] | None = None) -> DataFrame:
    """df(score, expected) -> by, threshold: the negative score at rank ceil((1 - share) n), 0.5 at least."""
    by = by or []
    points = materialise(df.filter(~F.col("expected")).groupBy(*by, "score").agg(F.count("*").alias("c")))  # read twice
    whole = points.groupBy(*by).agg(F.sum("c").alias("n"))
    x = running(points, by, "score", {"before": F.col("c")})
    x = x.join(whole, by) if by else x.crossJoin(F.broadcast(whole))  # one row
    at = F.least(F.greatest(F.ceil((1 - F.lit(share)) * F.col("n")), F.lit(1)), F.col("n"))
    x = x.filter((F.col("before") < at) & (F.col("before") + F.col("c") >= at))
    return x.select(*by, F.greatest(F.lit(0.5), F.col("score")).alias("threshold"))


def verdict(df: DataFrame, model: Model | None) -> DataFrame:
    """Adds model_score and model_hot; both null without a model, or for another language than the model's."""
    if model is None:
        return df.withColumns({"model_score": F.lit(None).cast("double"), "model_hot": F.lit(None).cast("boolean")})
    own = F.lit(True) if model.lang is None else F.col("lang") == model.lang
    x = df.withColumn("model_score", F.when(own, r6(predict(model))))
    return x.withColumn("model_hot", F.col("model_score") >= model.threshold)
