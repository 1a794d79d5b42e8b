import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftlink.llm import grades as G
from weftlink.llm import kernels as K

SCHEMA = "doc_id long, text string, kept string, tail int"


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for i in range(n):
        g = rng.randint(0, 2)
        w = [word() for _ in range(rng.randint(10, 60))]
        if g == 0:
            w[rng.randrange(len(w))] = "nasty"
            w[rng.randrange(len(w))] = "Vile."
        if g == 1:
            w = [x + "##" for x in w]
        out.append((i, " ".join(w), g))
    return out


def test_grades_are_told_apart_in_order(rows):
    data = corpus(500)
    docs = rows([(i, t, "x", 1) for i, t, _ in data], SCHEMA)
    ratings = rows([(i, g) for i, _, g in data if i % 2], "doc_id long, grade int")
    model = G.learn(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in G.grade(docs, model).collect()}
    apart = [(out[i], g) for i, _, g in data if i % 2 == 0]
    assert np.mean([r["kept"] == (g == 2) for r, g in apart]) > 0.95
    means = [np.mean([r["expected_grade"] for r, g in apart if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r, _ in apart)


def likelihood(z, t, g):
    s = np.concatenate([[1.0], G.sigmoid(z - t), [0.0]])
    return np.log(s[g] - s[g + 1])


def test_slopes_are_those_of_the_likelihood():
    step = 1e-6
    for t in (np.array([-1.0, 0.5]), np.array([0.2]), np.array([-2.0, -1.9, 0.0, 3.0])):
        for z in (-1.5, 0.3, 2.0):
            for g in range(len(t) + 1):
                dz, dt = G.slopes(G.sigmoid(z - t), g)
                assert abs(dz - (likelihood(z + step, t, g) - likelihood(z - step, t, g)) / (2 * step)) < 1e-5
                for k, e in enumerate(np.eye(len(t)) * step):
                    assert abs(dt[k] - (likelihood(z, t + e, g) - likelihood(z, t - e, g)) / (2 * step)) < 1e-5


def test_training_comes_near_plain_descent():
    """The thresholds and weights of a full-batch ascent on the same likelihood, in dense arrays, by small steps."""
    rng = np.random.default_rng(5)
    n, k, truth, cuts = 1500, 12, rng.normal(size=12), np.array([-0.7, 0.9])
    x = rng.random((n, k)) < 0.4
    noisy = x @ truth + rng.logistic(size=n)
    grades = (noisy[:, None] > cuts).sum(1)
    model = G.train([(int(g), np.flatnonzero(r)) for g, r in zip(grades, x, strict=True)], 4, 3, epochs=40)
    w, t = np.zeros(k), np.array([-1.0, 1.0])
    for _ in range(4000):
        dw, dt = np.zeros(k), np.zeros(2)
        s = G.sigmoid((x @ w)[:, None] - t)
        above, below = np.c_[np.ones(n), s][np.arange(n), grades], np.c_[s, np.zeros(n)][np.arange(n), grades]
        dz = 1 - above - below  # what (above' - below') / (above - below) comes to
        dw = x.T @ dz / n
        for j in range(2):
            slope = s[:, j] * (1 - s[:, j]) / (above - below)
            dt[j] = (np.where(grades == j, slope, 0) - np.where(grades == j + 1, slope, 0)).sum() / n
        w, t = w + 0.5 * dw, t + 0.5 * dt
    mean = lambda weights, cut: np.mean([likelihood(z, cut, g) for z, g in zip(x @ weights, grades, strict=True)])
    best, mine = mean(w, t), mean(model.weights[:k], model.thresholds)
    assert best - 0.01 < mine <= best + 1e-6
    expected = lambda weights, cut: G.sigmoid((x @ weights)[:, None] - cut).sum(1)
    assert np.corrcoef(expected(w, t), expected(model.weights[:k], model.thresholds))[0, 1] > 0.99


def plain_features(text, bits):
    """What features() says, one text and one feature at a time."""
    mask, found = (1 << bits) - 1, set()
    mix = lambda v: int(K.mixed(np.array([v & (1 << 64) - 1], np.uint64))[0])
    raw = text.encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw)]
    for w in words:
        b = np.frombuffer(w, np.uint8)
        found.add(int(K.word_hashes(b, np.array([0]), np.array([len(b)]))[0]) & mask)
    sign = lambda c: not re.match(rb"[A-Za-z0-9\x80-\xff \t-\r]", bytes([c]))
    for a, b in zip(raw, raw[1:], strict=False):
        if sign(a) and sign(b):
            found.add(mix(a * 257 + b + (1 << 40)) & mask)
    found.add(mix(int(10 * (1 - len(set(words)) / max(len(words), 1))) + (1 << 41)) & mask)
    found.add(mix(int(np.log2(len(words) + 1)) + (1 << 42)) & mask)
    return found


def test_grades_equal_plain_scores(rows):
    data = [(i, t, "x", 1) for i, t, _ in corpus(60, 3)] + [(900, None, "", 0), (901, "", "", 0), (902, "Été ## $$ x1y été", "", 0), (903, "7 7 %%%", "", 0)]
    rng = np.random.default_rng(2)
    model = G.Model(rng.normal(size=1 << 14), np.array([-0.4, 0.8]), 14)
    out = {r["doc_id"]: r for r in G.grade(rows(data, SCHEMA), model).collect()}
    for i, text, *_ in data:
        z = sum(model.weights[k] for k in plain_features(text or "", 14))
        p = [1 / (1 + math.exp(-(z - t))) for t in model.thresholds]
        assert abs(out[i]["expected_grade"] - sum(p)) < 1e-9 and abs(out[i]["tail"] - p[1]) < 1e-9


def test_graded(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1), (None, 0), (None, 1), (0, None)], "quality int, toxic int")
    assert [r["g"] for r in df.select(G.graded(F.col("quality"), F.col("toxic")).alias("g")).collect()] == [2, 1, 0, None, 0, 1]


def test_nulls_repeats_and_nothing_to_learn(rows, spark):
    docs = rows([(1, None, "", 0), (2, "", "", 0), (3, "## !!", "", 0), (1, None, "", 0), (None, "a b", "", 0), (4, "w " * 50000, "", 0)], SCHEMA)
    model = G.learn(docs, spark.createDataFrame([(None, 1), (1, None), (2, 9)], "doc_id long, grade int"))
    out = G.grade(docs, model).collect()
    assert len(out) == 6 and all(np.isfinite(r["tail"]) for r in out)
    assert G.grade(spark.createDataFrame([], SCHEMA), model).count() == 0
