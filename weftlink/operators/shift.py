"""Domain shift: density weights, their stabilisation, and covariance alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = 128


def kish_n_eff(weight: Column) -> Column:
    """Aggregate: the effective sample size, 0 where there is next to no weight."""
    squares = F.sum(weight * weight)
    return F.when(squares <= 1e-12, 0.0).otherwise(F.pow(F.sum(weight), 2) / squares)


def weight_summary(rows: DataFrame, weight: str = "weight", by: list[str] | None = None) -> DataFrame:
    """by, n, min, mean, max and n_eff of weights."""
    w = F.col(weight)
    return rows.groupBy(*(by or [])).agg(F.count(w).alias("n"), F.min(w).alias("min"), F.avg(w).alias("mean"), F.max(w).alias("max"), kish_n_eff(w).alias("n_eff"))


def domain_probabilities(rows: DataFrame, columns: list[str], target: str = "is_target", c: float = 1.0, keep: tuple = ()) -> DataFrame:
    """keep and prob: P(target | columns) by logistic regression with penalty 1 / (2c)."""
    n = rows.count()
    data = VectorAssembler(inputCols=columns, outputCol="__x").transform(rows.withColumn("__y", F.col(target).cast("double")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8).fit(data)
    return model.transform(data).select(*keep, target, vector_to_array("probability")[1].alias("prob"))


def density_weights(scored: DataFrame, target: str = "is_target", edge: float = 1e-4, clip: tuple[float, float] | None = (0.01, 10.0)) -> DataFrame:
    """scored with weight: the odds of being from the target, times n_source / n_target."""
    n = scored.agg(F.count_if(~F.col(target).cast("boolean")).alias("s"), F.count_if(F.col(target).cast("boolean")).alias("t")).first()
    p = F.least(F.greatest("prob", F.lit(edge)), F.lit(1 - edge))
    w = p / (1 - p) * (n["s"] / max(n["t"], 1))
    return scored.withColumn("weight", w if clip is None else F.least(F.greatest(w, F.lit(clip[0])), F.lit(clip[1])))


def shrinkage(rows: DataFrame, weight: str = "weight", min_share: float = 0.5) -> DataFrame:
    """n, mean, raw_n_eff, beta, n_eff in one row.

    beta is the largest share of the raw weights, the rest being their mean,
    with n_eff >= min_share * n: 1, or mean / sd * sqrt((1 - s) / s).
    """
    w = F.col(weight)
    one = rows.agg(F.count(w).alias("n"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("sd"), kish_n_eff(w).alias("raw_n_eff"))
    beta = F.when((F.col("raw_n_eff") >= min_share * F.col("n")) | (F.col("sd") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.col("mean") / F.col("sd") * ((1 - min_share) / min_share) ** 0.5))
    out = one.withColumn("beta", beta)
    spread = F.col("beta") * F.col("sd") / F.col("mean")
    return out.withColumn("n_eff", F.col("n") / (1 + spread * spread)).drop("sd")


def shrunk(rows: DataFrame, weight: str = "weight", min_share: float = 0.5) -> DataFrame:
    """rows with stable_weight = beta * weight + (1 - beta) * mean."""
    s = shrinkage(rows, weight, min_share).select("beta", "mean")
    return rows.crossJoin(F.broadcast(s)).withColumn("stable_weight", F.col("beta") * F.col(weight) + (1 - F.col("beta")) * F.col("mean")).drop("beta", "mean")


def mean_and_covariance(rows: DataFrame, columns: list[str], sample: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """By aggregates of p means and p (p + 1) / 2 covariances, at most WIDE at once."""
    of = F.covar_samp if sample else F.covar_pop
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    p = len(columns)
    wanted = [*(F.avg(c) for c in columns), *(of(columns[i], columns[j]) for i, j in pairs)]
    row = [x for at in range(0, len(wanted), WIDE) for x in rows.agg(F.count(F.lit(1)), *wanted[at : at + WIDE]).first()[bool(at) :]]
    cov = np.zeros((p, p))
    for (i, j), x in zip(pairs, row[1 + p :], strict=True):
        cov[i, j] = cov[j, i] = x if x is not None else 0.0
    return np.array([x or 0.0 for x in row[1 : 1 + p]]), cov, row[0]


@dataclass(frozen=True)
class Alignment:
    """x -> (x - source) @ matrix + target."""

    columns: tuple
    source: np.ndarray
    target: np.ndarray
    matrix: np.ndarray

    def transform(self, rows: DataFrame, suffix: str = "") -> DataFrame:
        number = lambda x: f"double('{float(x)!r}')"
        each = [f"struct({number(t)} AS t, array({', '.join(map(number, m))}) AS m)" for t, m in zip(self.target, self.matrix.T, strict=True)]
        moved = F.array(*(F.col(c) - float(m) for c, m in zip(self.columns, self.source, strict=True)))
        out = F.transform(F.expr(f"array({', '.join(each)})"), lambda to: F.aggregate(F.zip_with("__moved", to["m"], lambda a, b: a * b), to["t"], lambda a, b: a + b))
        whole = rows.withColumn("__moved", moved).withColumn("__moved", out)
        return whole.withColumns({c + suffix: F.col("__moved")[j] for j, c in enumerate(self.columns)}).drop("__moved")


def _root(a: np.ndarray, power: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    return (vectors * np.maximum(values, 1e-12) ** power) @ vectors.T


def fit_alignment(source: DataFrame, target: DataFrame, columns: list[str], ridge: float = 1e-4) -> Alignment:
    """Correlation alignment: whiten with the source's covariance, colour with the target's."""
    ms, cs, _ = mean_and_covariance(source, columns)
    mt, ct, _ = mean_and_covariance(target, columns)
    eye = ridge * np.eye(len(columns))
    return Alignment(tuple(columns), ms, mt, _root(cs + eye, -0.5) @ _root(ct + eye, 0.5))
