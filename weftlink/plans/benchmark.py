"""The conformal benchmark: paradigms side by side on scored pairs with a shifted domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, shift

COLUMNS = ["name_sim", "addr_sim", "token_jaccard"]


def compare(pairs: DataFrame, alpha_0: float = 0.02, alpha_1: float = 0.15, seed: int = 42) -> DataFrame:
    """paradigm, slice and the figures of calibration.evaluated().

    Groups are split in halves of training, a quarter of calibration and a
    quarter of test rows.  Paradigms: one quantile for both labels, quantiles by
    label, those weighted by the density of the shifted domain, and those of
    the best pair of levels on the calibration rows.
    """
    rows = calibration.group_split(pairs, "cluster_id", (0.5, 0.25, 0.25), seed).withColumnRenamed("raw_logit", "logit")
    held = rows.where("split = 1")
    t = calibration.fit_temperature(held)
    scaled = rows.withColumn("prob", calibration.scaled(F.col("logit"), t))
    held, test = scaled.where("split = 1"), scaled.where("split = 2")
    weights = shift.density_weights(_with_density(held), "is_target_domain")
    grid = calibration.alpha_grid(held, (0.005, 0.01, 0.02, 0.05, 0.1), (0.02, 0.05, 0.08, 0.1, 0.15, 0.2))
    best = grid.orderBy(F.desc("pair_f05"), "alpha_0", "alpha_1").first()
    found = {
        "marginal": calibration.fit_marginal(held),
        "by label": calibration.fit_classes(held, alpha_0, alpha_1),
        "weighted": calibration.fit_classes(weights, alpha_0, alpha_1, prob="match_prob", weight="weight"),
        "optimised": calibration.ClassQuantiles(best["q0"], best["q1"]),
    }
    out = None
    for name, q in found.items():
        sets = test.withColumn("labels", calibration.prediction_set(F.col("prob"), q.q0, q.q1))
        for part, where in (("all", F.lit(True)), ("shifted", F.col("is_target_domain") == 1), ("usual", F.col("is_target_domain") == 0)):
            one = calibration.evaluated(sets.where(where)).select(F.lit(name).alias("paradigm"), F.lit(part).alias("slice"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def _with_density(held: DataFrame) -> DataFrame:
    """The calibration rows with prob: that of the shifted domain; the match's is kept as match_prob."""
    rows = held.withColumn("match_prob", F.col("prob")).drop("prob")
    return shift.domain_probabilities(rows, COLUMNS, "is_target_domain", keep=("match_prob", "label"))
