"""Temperature scaling and conformal prediction sets.

Fits return plain numbers: each is a few aggregates over the calibration rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import conformal_rank, quantiles, running_total, values_at
from .metrics import pair_counts, with_scores

ROUTE_AT = 0.82


@dataclass(frozen=True)
class ClassQuantiles:
    """The largest admitted score of label 0 and of label 1."""

    q0: float
    q1: float


def scaled(logit: Column, temperature: float | Column) -> Column:
    """The probability of label 1; logits are clipped to 30 after scaling."""
    z = F.least(F.greatest(logit / temperature, F.lit(-30.0)), F.lit(30.0))
    return 1 / (1 + F.exp(-z))


def _nll(logit: Column, label: Column, temperature) -> Column:
    p = scaled(logit, temperature)
    return F.avg(-(label * F.log(p + 1e-12) + (1 - label) * F.log(1 - p + 1e-12)))


def temperature_losses(rows: DataFrame, temperatures, logit: str = "logit", label: str = "label") -> DataFrame:
    """temperature, nll for a grid, in one pass."""
    grid = F.array(*(F.lit(float(t)) for t in temperatures))
    return rows.select(logit, label, F.explode(grid).alias("temperature")).groupBy("temperature").agg(_nll(F.col(logit), F.col(label), F.col("temperature")).alias("nll"))


def fit_temperature(rows: DataFrame, logit: str = "logit", label: str = "label", low: float = 0.05, high: float = 10.0, rounds: int = 6, each: int = 17) -> float:
    """The temperature of least loss: grids that narrow around the best point, which the loss allows, being convex in 1/T."""
    best = 1.0
    for _ in range(rounds):
        grid = [1 / (1 / high + (1 / low - 1 / high) * i / (each - 1)) for i in range(each)]
        row = rows.agg(*(_nll(F.col(logit), F.col(label), t).alias(f"t{i}") for i, t in enumerate(grid))).first()
        losses = [row[i] if row[i] is not None else float("inf") for i in range(each)]
        k = losses.index(min(losses))
        best, low, high = grid[k], grid[min(k + 1, each - 1)], grid[max(k - 1, 0)]
    return best


def nonconformity(prob: Column, label: Column) -> Column:
    return F.when(label == 1, 1 - prob).otherwise(prob)


def fit_classes(rows: DataFrame, alpha_0: float = 0.02, alpha_1: float = 0.15, prob: str = "prob", label: str = "label", weight: str | None = None, empty: float = 0.5) -> ClassQuantiles:
    """Class-conditional quantiles, weighted if a weight is named; a label without rows gets ``empty``.

    Unweighted, the quantile is the (k + 1)-th smallest score for
    k = ceil((n + 1)(1 - alpha)), or the largest.  Weighted, it is the first
    score at which the share of weight reaches that level, or the largest.
    """
    scored = rows.select(F.col(label).cast("int").alias("y"), nonconformity(F.col(prob), F.col(label)).alias("score"), *([F.col(weight).alias("w")] if weight else []))
    n = {r["y"]: r["n"] for r in scored.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where(F.col("y").isin(0, 1)).collect()}
    alphas, found = {0: alpha_0, 1: alpha_1}, {}
    if weight is None and n:
        ranks = rows.sparkSession.createDataFrame([(y, conformal_rank(k, alphas[y])) for y, k in n.items()], "y int, rank long")
        found = {r["y"]: r["value"] for r in values_at(scored, ["y"], "score", ranks).collect()}
    elif n:
        total = running_total(scored, ["y"], "score", F.col("w"))
        whole = scored.groupBy("y").agg(F.sum("w").alias("all"), F.max("score").alias("top"))
        level = F.create_map(*(F.lit(x) for y, k in n.items() for x in (y, min(conformal_level(k, alphas[y]), 1.0))))
        reach = total.join(F.broadcast(whole), "y").where(F.col("upto") / F.col("all") >= F.element_at(level, F.col("y")))
        firsts = reach.groupBy("y").agg(F.min("value").alias("value"))
        found = {r["y"]: r["q"] for r in whole.join(firsts, "y", "left").select("y", F.coalesce("value", "top").alias("q")).collect()}
    return ClassQuantiles(found.get(0, empty), found.get(1, empty))


def conformal_level(n: int, alpha: float) -> float:
    return math.ceil(round((n + 1) * (1 - alpha), 9)) / n


def fit_marginal(rows: DataFrame, alpha: float = 0.05, prob: str = "prob", label: str = "label") -> ClassQuantiles:
    """One quantile for both labels, linear between ranks."""
    scored = rows.select(nonconformity(F.col(prob), F.col(label)).alias("score")).where(F.col("score").isNotNull())
    n = scored.count()
    q = quantiles(scored, ["score"], [min(conformal_level(n, alpha), 1.0)]).first()["quantile"]
    return ClassQuantiles(q, q)


def prediction_set(prob: Column, q0, q1) -> Column:
    """The labels whose score is admitted: [], [0], [1] or [0, 1]."""
    as_column = lambda q: q if isinstance(q, Column) else F.lit(q)
    return F.array_compact(F.array(F.when(prob <= as_column(q0), 0), F.when(1 - prob <= as_column(q1), 1)))


def routed(labels: Column, prob: Column, threshold: float = ROUTE_AT) -> Column:
    """1 or 0: a single label as it is, two by the threshold, none as 0."""
    both = (F.size(labels) == 2) & (prob >= threshold)
    return F.when((F.size(labels) == 1) & F.array_contains(labels, 1) | both, 1).otherwise(0)


def evaluated(rows: DataFrame, labels: str = "labels", prob: str = "prob", label: str = "label", threshold: float = ROUTE_AT) -> DataFrame:
    """Coverage, set sizes and routed pair scores in one row; the coverage of a label without rows is 1."""
    s, y = F.col(labels), F.col(label)
    inside = F.array_contains(s, y.cast("int")).cast("double")
    size = lambda k: F.avg((F.size(s) == k).cast("double"))
    one = rows.agg(
        F.avg(inside).alias("coverage"),
        F.coalesce(F.avg(F.when(y == 0, inside)), F.lit(1.0)).alias("coverage_0"),
        F.coalesce(F.avg(F.when(y == 1, inside)), F.lit(1.0)).alias("coverage_1"),
        F.avg(F.size(s)).alias("mean_size"),
        size(1).alias("share_single"),
        size(2).alias("share_double"),
        size(0).alias("share_empty"),
        *pair_counts(routed(s, F.col(prob), threshold) == 1, y),
    )
    return with_scores(one)


def alpha_grid(rows: DataFrame, alphas_0, alphas_1, prob: str = "prob", label: str = "label", threshold: float = ROUTE_AT) -> DataFrame:
    """alpha_0, alpha_1, q0, q1 and routed pair scores for a grid, all from two passes over the rows."""
    scored = rows.select(F.col(label).cast("int").alias("y"), nonconformity(F.col(prob), F.col(label)).alias("score"))
    n = {r["y"]: r["n"] for r in scored.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {(y, a): conformal_rank(n[y], a) for y, alphas in ((0, alphas_0), (1, alphas_1)) for a in alphas if n.get(y)}
    ranks = rows.sparkSession.createDataFrame([(y, r) for y, r in sorted({(y, r) for (y, _), r in rank.items()})], "y int, rank long")
    q = {(r["y"], r["rank"]): r["value"] for r in values_at(scored, ["y"], "score", ranks).collect()}
    grid = [(float(a), float(b), q.get((0, rank.get((0, a))), 0.5), q.get((1, rank.get((1, b))), 0.5)) for a in alphas_0 for b in alphas_1]
    table = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(g, ("alpha_0", "alpha_1", "q0", "q1"), strict=True))) for g in grid))
    long = rows.select(prob, label, F.explode(table).alias("g")).select(prob, label, "g.*")
    yes = routed(prediction_set(F.col(prob), F.col("q0"), F.col("q1")), F.col(prob), threshold) == 1
    return with_scores(long.groupBy("alpha_0", "alpha_1", "q0", "q1").agg(*pair_counts(yes, F.col(label))))


def group_split(rows: DataFrame, group: str, shares=(0.5, 0.25, 0.25), seed: int = 42, order: Column | None = None) -> DataFrame:
    """rows with a split number: whole groups, the first floor(n * share) of a seeded order and so on, the rest last."""
    key = order if order is not None else F.xxhash64(F.lit(seed), F.col(group))
    groups = rows.select(F.col(group).alias("g"), key.alias("o")).distinct()
    n = groups.count()
    ends, at = [], 0
    for s in shares[:-1]:
        at += int(n * s)
        ends.append(at)
    counted = running_total(groups, [], "o", F.lit(1)) if n else None
    if counted is None:
        return rows.withColumn("split", F.lit(len(shares) - 1))
    number = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("upto")))
    placed = groups.join(counted.select(F.col("value").alias("o"), number.alias("split")), "o").select(F.col("g").alias(group), "split")
    return rows.join(placed, group, "left")


def split_overlap(split: DataFrame, group: str) -> DataFrame:
    """n_shared: groups that are in more than one split."""
    return split.groupBy(group).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_shared"))


def folds(rows: DataFrame, group: str, n: int = 5, stratum: str | None = None, seed: int = 42, order: Column | None = None) -> DataFrame:
    """rows with a fold number by group, dealt evenly within each stratum in the order of a seeded hash, or another."""
    keys = [c for c in (stratum,) if c]
    groups = rows.select(group, *keys).dropDuplicates([group]).withColumn("o", order if order is not None else F.xxhash64(F.lit(seed), F.col(group)))
    counted = running_total(groups, keys, "o", F.lit(1)).select(*keys, F.col("value").alias("o"), ((F.col("upto") - 1) % n).cast("int").alias("fold"))
    return rows.join(groups.join(counted, [*keys, "o"]).select(group, "fold"), group, "left")
