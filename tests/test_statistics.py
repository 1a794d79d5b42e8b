import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftlink.operators import calibration as C
from weftlink.operators import metrics as M
from weftlink.operators import profiling as P
from weftlink.operators import shift as H
from weftlink.plans import order as O


def test_worked_metric_example(spark):
    scored = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.9)], "s1_id string, label int, prob double")
    who = spark.createDataFrame([("a",)], "s1_id string")
    assert M.macro_f_half(who, scored, (0.5,)).first()["macro_f05"] == pytest.approx(0.7142857)
    both = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    extra = scored.union(spark.createDataFrame([("b", 0, 0.9)], scored.schema))
    assert M.macro_f_half(both, extra, (0.5,)).first()["macro_f05"] == pytest.approx((0.7142857 + 0 + 1) / 3)


def test_first_threshold_wins_ties(spark):
    rows = spark.createDataFrame([(0.5, 0.9), (0.65, 0.9), (0.75, 0.1)], "threshold double, macro_f05 double")
    assert M.best(rows).first()["threshold"] == 0.5


def test_running_totals_ranks_and_quantiles(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500).round(2), np.full(300, 7.0)])
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(x)] + [(None, 1)], "v double, g int").repartition(5)
    got = sorted((r["value"], r["upto"]) for r in O.running_total(df, [], "v", F.lit(1)).collect())
    s = np.sort(x)
    assert all(n == np.searchsorted(s, v, "right") for v, n in got) and len(got) == len(np.unique(x))
    q = {r["prob"]: r["quantile"] for r in O.quantiles(df, ["v"], [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    assert all(q[p] == pytest.approx(np.quantile(x, p)) for p in q)


@pytest.mark.parametrize(("n", "alpha", "rank"), [(100, 0.05, 97), (19, 0.05, 19), (1, 0.5, 1)])
def test_conformal_ranks(n, alpha, rank):
    assert O.conformal_rank(n, alpha) == rank
    s = np.arange(1, n + 1)
    k = int(np.ceil(round((n + 1) * (1 - alpha), 9)))
    assert np.quantile(s, min(k / n, 1.0), method="higher") == rank


def test_sets_routing_and_coverage(spark):
    rows = spark.createDataFrame([(0.01, 0), (0.5, 1), (0.99, 1)], "prob double, label int")
    out = rows.withColumn("labels", C.prediction_set(F.col("prob"), 0.0225, 0.0558)).orderBy("prob").collect()
    assert [r["labels"] for r in out] == [[0], [], [1]]
    route = lambda s, p: spark.range(1).select(C.routed(F.array(*map(F.lit, s)) if s else F.array().cast("array<int>"), F.lit(p)).alias("x")).first()["x"]
    assert (route([0, 1], 0.82), route([0, 1], 0.81), route([], 0.9), route([1], 0.1), route([0], 0.9)) == (1, 0, 0, 1, 0)
    e = C.evaluated(rows.where("label = 0").withColumn("labels", C.prediction_set(F.col("prob"), 0.0225, 0.0558))).first()
    assert e["coverage_1"] == 1.0 and e["coverage_0"] == 1.0


def calibration_rows(spark, n=600):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, n)
    z = (2 * y - 1) * 1.5 + rng.normal(size=n) * 2
    return y, z, spark.createDataFrame([(int(a), float(b), float(1 / (1 + np.exp(-b))), float(1 + a)) for a, b in zip(y, z, strict=True)], "label int, logit double, prob double, w double")


def test_temperature_is_the_minimum(spark):
    y, z, rows = calibration_rows(spark)
    loss = lambda t: -np.mean(np.log(np.where(y == 1, 1 / (1 + np.exp(-z / t)), 1 / (1 + np.exp(z / t)))))
    grid = np.geomspace(0.05, 10, 4000)
    assert C.fit_temperature(rows) == pytest.approx(grid[np.argmin([loss(t) for t in grid])], rel=5e-3)


def test_class_quantiles_cover(spark):
    y, z, rows = calibration_rows(spark)
    p = 1 / (1 + np.exp(-z))
    q = C.fit_classes(rows, 0.1, 0.2)
    for label, alpha, got in ((0, 0.1, q.q0), (1, 0.2, q.q1)):
        s = np.sort(np.where(y == 1, 1 - p, p)[y == label])
        assert got == pytest.approx(s[O.conformal_rank(len(s), alpha) - 1])
        assert (s <= got).mean() >= 1 - alpha
    w = C.fit_classes(rows, 0.1, 0.2, weight="w")
    assert abs(w.q0 - q.q0) < 0.05
    assert C.fit_classes(rows.where("label = 1")).q0 == 0.5


def test_group_split_and_folds(spark):
    rows = spark.createDataFrame([(f"g{i % 41}", i) for i in range(400)], "g string, i int")
    out = C.group_split(rows, "g")
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes == {0: 20, 1: 10, 2: 11} and out.count() == 400
    assert C.split_overlap(out, "g").first()["n_shared"] == 0
    f = C.folds(rows.withColumn("s", F.col("g") > "g2"), "g", 5, "s")
    assert f.count() == 400 and C.split_overlap(f.withColumnRenamed("fold", "split"), "g").first()["n_shared"] == 0


def test_effective_sample_size_and_shrinkage(spark):
    rng = np.random.default_rng(1)
    w = np.exp(rng.normal(size=1000) * 1.5)
    rows = spark.createDataFrame([(float(x),) for x in w], "weight double")
    s = H.shrinkage(rows).first()
    neff = lambda v: v.sum() ** 2 / (v**2).sum()
    assert s["raw_n_eff"] == pytest.approx(neff(w)) and s["n_eff"] == pytest.approx(500)
    stable = np.array([r["stable_weight"] for r in H.shrunk(rows).collect()])
    assert neff(stable) == pytest.approx(500) and stable.mean() == pytest.approx(w.mean())
    flat = H.shrinkage(spark.createDataFrame([(1.0,)] * 5, "weight double")).first()
    assert flat["beta"] == 1.0


def test_domain_weights_favour_the_target(spark):
    rng = np.random.default_rng(42)
    data = [(float(x), False) for x in rng.normal(size=600)] + [(float(x), True) for x in rng.normal(1.0, 1, 300)]
    out = H.density_weights(H.domain_probabilities(spark.createDataFrame(data, "x double, is_target boolean"), ["x"], keep=("x",)))
    lo, hi = (out.where(c).agg(F.avg("weight")).first()[0] for c in ("x < -1", "x > 1"))
    assert lo < 0.6 < 1.5 < hi


def test_alignment(spark):
    rng = np.random.default_rng(0)
    frame = lambda a: spark.createDataFrame([tuple(map(float, r)) for r in a], "a double, b double, c double")
    s, t = frame(rng.normal(size=(500, 3)) * 2.5 + 1.2), frame(rng.normal(size=(200, 3)) * 0.8 - 0.5)
    out = H.fit_alignment(s, t, ["a", "b", "c"], 1e-5).transform(s)
    _, c1, _ = H.mean_and_covariance(out, ["a", "b", "c"])
    _, c2, _ = H.mean_and_covariance(t, ["a", "b", "c"])
    assert np.linalg.norm(c1 - c2) < 1e-3


def test_profile_against_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.exponential(size=400), "b": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    m = {r["name"]: r for r in P.moments(df, ["a", "b"]).collect()}
    for c in "ab":
        assert m[c]["skew"] == pytest.approx(pdf[c].skew()) and m[c]["kurt"] == pytest.approx(pdf[c].kurt()) and m[c]["median"] == pytest.approx(pdf[c].median())
    f = {r["name"]: r for r in P.iqr_fences(df, ["a", "b"]).collect()}
    q1, q3 = pdf.a.quantile([0.25, 0.75])
    assert f["a"]["upper"] == pytest.approx(q3 + 1.5 * (q3 - q1))
    z = P.zscore_flags(df, ["a"]).where("z_a").count()
    assert z == int((((pdf.a - pdf.a.mean()) / pdf.a.std()).abs() > 3).sum())
    d = P.mahalanobis(df, ["a", "b"], 0.01).where("mahalanobis").count()
    x = pdf.to_numpy() - pdf.to_numpy().mean(0)
    inv = np.linalg.inv(np.cov(x.T, bias=True))
    assert d == int((np.einsum("ij,jk,ik->i", x, inv, x) > P.chi_square_upper(2, 0.01)).sum())


def test_chi_square():
    assert P.chi_square_upper(6) == pytest.approx(22.458, abs=1e-3)
    assert P.chi_square_upper(1, 0.05) == pytest.approx(3.8415, abs=1e-3)
    assert P.chi_square_upper(3, 0.05) == pytest.approx(7.8147, abs=1e-3)
    assert P.chi_square_upper(5, 0.5) == pytest.approx(4.3515, abs=1e-3)


def test_robust_distance_is_not_misled(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(600, 2)), rng.normal(size=(80, 2)) * 0.3 + 9])
    df = spark.createDataFrame([(*map(float, r), i >= 600) for i, r in enumerate(x)], "a double, b double, odd boolean")
    out = P.robust_outliers(df, ["a", "b"])
    assert out.where("odd and robust").count() == 80 and out.where("not odd and robust").count() < 20
    assert 5 <= out.where("envelope").count() <= 8


def test_nulls_are_imputed(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "a double")
    assert sorted(r["a"] for r in P.impute_median(df, ["a"]).collect()) == [1.0, 3.0, 3.0, 10.0]
    assert P.null_profile(df, ["a"]).first().asDict() == {"name": "a", "n_null": 1, "pct_null": 25.0}
