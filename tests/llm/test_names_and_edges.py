import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import common, components, grades, host_rules, mixing, nearcopies, pieces, suffixes
from weftlink.llm.queries import PIECES, TARGETS

TEXT = "one two three four five six seven eight nine ten eleven twelve"
CLASHES = ["counts", "host_key", "failed", "refused", "Counts", "did", "uid", "key", "copies", "nth", "raw_text", "__rules", "__failed", "__host", "__did", "__uid", "__id", "__hash", "__copies", "__copy", "__text", "__n"]


@pytest.fixture
def clashing(spark):
    """A row for each name that operators use inside, each with its own value."""
    rows = spark.createDataFrame([(i, f"{TEXT} {i}" * 3, "host") for i in range(6)], "doc_id long, text string, source string")
    return rows.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES if c != "Counts"))


def check_untouched(found, source):
    assert found.columns == source.columns
    for r in found.collect():
        assert all(r[c] == f"mine {c}" for c in source.columns[3:])


def test_no_operator_touches_columns_of_its_inner_names(spark, clashing):
    check_untouched(host_rules.keep_good(clashing), clashing)
    check_untouched(nearcopies.dedup_rows(clashing), clashing)
    check_untouched(suffixes.dedup_rows(clashing), clashing)
    labels = spark.createDataFrame([(0, "high"), (1, "low")], "doc_id long, domain string")
    drawn = mixing.draw(clashing, labels, TARGETS)
    assert drawn.count() > 0
    check_untouched(drawn, clashing)
    encoded = pieces.encode(clashing, PIECES)
    assert encoded.count() == 6 and {r["raw_text"] for r in encoded.collect()} == {"mine raw_text"}


def test_fresh_names_differ_in_any_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Key long, key_ long, other long")
    assert common.fresh(df, "key", "key") == ["key__", "key___"]


def test_hot_keys_are_looked_up_like_others(spark):
    rows = spark.range(20_000).select((F.when(F.col("id") < 9000, 7).when(F.col("id") < 9010, None).otherwise(F.col("id") % 50)).alias("k"), "id")
    facts = spark.createDataFrame([(7, "hot"), (8, "cold")], "k long, name string")
    plain = rows.join(facts, "k", "left").select("k", "id", "name")
    found = common.looked_up(rows, facts, "k").select("k", "id", "name")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_components_of_a_star_with_many_followers(spark):
    star = spark.range(1, 9001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    tail = spark.createDataFrame([(9001 + i, 9000 + i) for i in range(30)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(star.unionByName(tail)).collect()}
    assert len(got) == 9031 and set(got.values()) == {0}


def test_many_hosts_are_judged_like_few(spark, monkeypatch):
    docs = spark.createDataFrame([(i, TEXT if i % 3 else "x", None if i % 7 == 0 else f"h{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    few = host_rules.host_rules(docs).orderBy("doc_id").select("doc_id", "kept", "host_rate").collect()
    kept = {r["doc_id"] for r in host_rules.keep_good(docs).collect()}
    monkeypatch.setattr(host_rules, "FEW_HOSTS", 1)
    many = host_rules.host_rules(docs).orderBy("doc_id").select("doc_id", "kept", "host_rate").collect()
    assert few == many and kept == {r["doc_id"] for r in host_rules.keep_good(docs).collect()} == {r["doc_id"] for r in few if r["kept"]}


def test_training_comes_near_the_best_likelihood():
    """Plain descent on the summed negative log-likelihood, by differences, on a few rows."""
    rng = np.random.default_rng(0)
    rows = [(int(g), np.unique(rng.integers(0, 4, 3) + 4 * g // 2)) for g in rng.integers(0, 3, 60)]

    def loss(w, t):
        total = 0.0
        for g, idx in rows:
            s = np.concatenate([[1.0], grades.sigmoid(w[idx].sum() - t), [0.0]])
            total -= np.log(max(s[g] - s[g + 1], 1e-9))
        return total / len(rows)

    model = grades.train(rows, 3, 3, epochs=200, least=1)
    x, step = np.concatenate([np.zeros(8), [-0.5, 0.5]]), 1e-5
    for _ in range(400):
        at = loss(x[:8], x[8:])
        g = np.array([(loss((x + step * e)[:8], (x + step * e)[8:]) - at) / step for e in np.eye(10)])
        x = x - 0.5 * g
    assert model.thresholds[0] < model.thresholds[1]
    assert loss(model.weights, model.thresholds) < loss(x[:8], x[8:]) + 0.03


def test_repeated_rows_teach_once(spark):
    docs = spark.createDataFrame([(i, f"{TEXT} {'bad' if i % 3 else 'good'} {i}") for i in range(60)], "doc_id long, text string")
    ratings = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    once, twice = grades.learn(docs, ratings), grades.learn(docs.unionByName(docs), ratings.unionByName(ratings))
    assert np.array_equal(once.weights, twice.weights) and np.array_equal(once.thresholds, twice.thresholds)


def test_very_long_texts_are_taken_whole(spark):
    import random

    from weftlink.llm import passages

    rng = random.Random(3)
    words = [f"w{rng.randint(0, 400)}" for _ in range(120_000)]
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long, "a"), (2, long + " tail", "a"), (3, " ".join(words[-60_000:-59_950]), "b")], "doc_id long, text string, source string")
    near = {r["doc_id"]: r for r in nearcopies.near_copies(docs).collect()}
    assert near[2]["component_id"] == 1 and near[3]["component_id"] == 3
    cut = {r["doc_id"]: r for r in passages.dedup(docs).collect()}
    assert cut[2]["n_words"] == 120_001 and cut[2]["n_removed"] == 120_000 and cut[3]["n_removed"] == 50
    labels = spark.createDataFrame([(1, "high"), (3, "low")], "doc_id long, domain string")
    mixed = {r["doc_id"]: r["n_tokens"] for r in mixing.mix(docs, labels, TARGETS).collect()}
    assert mixed[2] == mixed[1] + 1


def test_native_operators_hold_no_python(spark):
    docs = spark.createDataFrame([(i, TEXT * 2, f"h{i % 3}") for i in range(20)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, "high"), (1, "low")], "doc_id long, domain string")
    for df in (host_rules.host_rules(docs), host_rules.keep_good(docs), mixing.mix(docs, labels, TARGETS), mixing.draw(docs, labels, TARGETS)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))


def test_bucket_size_follows_the_session(spark):
    from weftlink.llm import exchange

    docs = spark.range(100).repartition(40)
    few = exchange.buckets_for(docs)
    spark.conf.set("weftlink.bucketBytes", "4mb")
    try:
        assert exchange.buckets_for(docs) == 4 * few
    finally:
        spark.conf.unset("weftlink.bucketBytes")
