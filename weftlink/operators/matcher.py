"""The learned matcher: boosted trees over pair features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep").transform(rows)


def fit(rows: DataFrame, features: list[str], label: str = "label", positive: float = 1.0, negative: float = 4.0, rounds: int = 400, rate: float = 0.04, depth: int = 5, least: int = 20, seed: int = 42, held: float = 0.15, gain: float = 0.02, group: str | None = None) -> GBTClassificationModel:
    """Boosted trees; negatives weigh more, so precision counts more.

    Boosting stops as soon as a round lowers the loss on held-out groups, a
    share ``held`` of them, by less than ``gain`` of it; with 0 all rounds run.
    Rows are grouped by s1_id, or by their features where there is none, unless
    a column is named.
    """
    data = assembled(rows.withColumn("__w", F.when(F.col(label) == 1, positive).otherwise(negative)).withColumn("__y", F.col(label).cast("double")), features)
    trees = GBTClassifier(featuresCol="__features", labelCol="__y", weightCol="__w", maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, seed=seed)
    if held:
        by = [group] if group else ["s1_id"] if "s1_id" in rows.columns else features
        data = data.withColumn("__held", F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(10_000)) < int(held * 10_000))
        kinds = data.agg(F.count_if("__held").alias("held"), F.count_if(~F.col("__held")).alias("rest")).first()
        if kinds["held"] and kinds["rest"]:
            trees = trees.copy({trees.validationIndicatorCol: "__held", trees.validationTol: gain})
    return trees.fit(data)


def logits(model: GBTClassificationModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with logit: twice the raw margin, whose sigmoid is the probability."""
    scored = model.transform(assembled(rows, features))
    return scored.withColumn("logit", 2 * vector_to_array("rawPrediction")[1]).drop("__features", "rawPrediction", "probability", "prediction")


def audit(gates: dict[str, bool]) -> None:
    """Stop with the names of the gates that don't hold."""
    failed = [name for name, ok in gates.items() if not ok]
    if failed:
        raise AssertionError("not met: " + ", ".join(failed))
