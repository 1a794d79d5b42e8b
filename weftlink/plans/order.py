"""Ranks, running totals and quantiles over whole columns without one big task.

Values are first counted, so that repeated ones cost one row.  The value range
is cut at approximate quantiles; within a cut a window runs, across cuts the
totals of at most ``cuts`` rows are added up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], value: str, weight: Column, cuts: int = 64) -> DataFrame:
    """group, value, weight, upto: each value's total weight and that of all values up to it."""
    each = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.sum(weight).alias("weight"))
    edges = each.groupBy(*group).agg(F.percentile_approx("value", F.array(*(F.lit(i / cuts) for i in range(1, cuts))), F.lit(10_000)).alias("edges"))
    placed = (each.join(F.broadcast(edges), group) if group else each.crossJoin(F.broadcast(edges))).withColumn("cut", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    totals = placed.groupBy(*group, "cut").agg(F.sum("weight").alias("w"))
    before = F.coalesce(F.sum("w").over(W.partitionBy(*group).orderBy("cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = totals.select(*group, "cut", before.alias("before"))
    inside = F.sum("weight").over(W.partitionBy(*group, "cut").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(offset), [*group, "cut"]).withColumn("upto", inside + F.col("before")).drop("cut", "before")


def values_at(df: DataFrame, group: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """group, rank, value: the rank-th smallest value (from 1) for each row of ranks (group, rank)."""
    counts = running_total(df, group, value, F.lit(1))
    ranks = F.broadcast(ranks)
    found = (counts.join(ranks, group) if group else counts.crossJoin(ranks)).where(F.col("upto") >= F.col("rank"))
    return found.groupBy(*group, "rank").agg(F.min("value").alias("value"))


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value: the columns below each other."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {parts}) as (name, value)")


#: Of approximate quantiles: their rank error is at most one in so many rows.
_FINE = 10_000


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """name, prob, quantile: linear between the two nearest ranks, nulls left out.

    Exact, without sorting the columns: approximate quantiles around each wanted
    one bound a narrow band of values, the rows below it are counted, and only
    the band's values are ranked.  A band that misses its ranks is the whole
    column.
    """
    spark, number = df.sparkSession, {c: F.col(f"`{c}`").cast("double") for c in columns}
    around = [min(max(q, 0.0), 1.0) for p in probs for q in (p - 3 / _FINE, p + 3 / _FINE)]
    marks = F.array(*map(F.lit, around))
    one = df.agg(*(x for i, c in enumerate(columns) for x in (F.count(number[c]).alias(f"n{i}"), F.percentile_approx(number[c], marks, F.lit(_FINE)).alias(f"q{i}")))).first()
    wanted = [(i, j, c, p, (one[f"n{i}"] - 1) * p) for i, c in enumerate(columns) if one[f"n{i}"] for j, p in enumerate(probs)]
    if not wanted:
        return spark.createDataFrame([], "name string, prob double, quantile double")
    edge = {(i, j): tuple(one[f"q{i}"][2 * j : 2 * j + 2]) for i, j, *_ in wanted}
    counts = df.agg(*(x for (i, j), (low, high) in edge.items() for x in (F.count_if(number[columns[i]] < low).alias(f"b{i}_{j}"), F.count_if(number[columns[i]].between(low, high)).alias(f"w{i}_{j}")))).first()
    cells, ranks = [], []
    for i, j, c, p, at in wanted:
        below, within = counts[f"b{i}_{j}"], counts[f"w{i}_{j}"]
        lowest, highest = math.floor(at) + 1, math.ceil(at) + 1
        holds = below < lowest and highest <= below + within
        inside = number[c].between(*edge[i, j]) if holds else number[c].isNotNull()
        cells.append(F.struct(F.lit(c).alias("name"), F.lit(float(p)).alias("prob"), F.when(inside, number[c]).alias("value")))
        ranks += [(c, float(p), r - (below if holds else 0), r == lowest, at - math.floor(at)) for r in {lowest, highest}]
    band = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where(F.col("value").isNotNull())
    asked = spark.createDataFrame(ranks, "name string, prob double, rank long, is_low boolean, share double")
    got = values_at(band, ["name", "prob"], "value", asked.select("name", "prob", "rank").distinct()).join(F.broadcast(asked), ["name", "prob", "rank"])
    both = got.groupBy("name", "prob").agg(F.max(F.when(F.col("is_low"), F.col("value"))).alias("low"), F.max("value").alias("high"), F.max("share").alias("share"))
    return both.select("name", "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("quantile"))


def conformal_rank(n: int, alpha: float) -> int:
    """The rank (from 1) of the finite-sample quantile that takes the next higher value."""
    k = math.ceil(round((n + 1) * (1 - alpha), 9))
    return min(k + 1, n)
