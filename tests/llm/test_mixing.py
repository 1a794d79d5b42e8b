import random

import numpy as np

from weftlink.llm import mixing as M

SCHEMA = "doc_id long, text string, p string, rate int"
TARGETS = {"a": 0.2, "b": 0.5, "c": 0.3}


def corpus(n, seed=0):
    rng = random.Random(seed)
    own = {"a": ["ant", "axe"], "b": ["bee", "bat"], "c": ["cat", "cow"]}
    docs, labels = [], []
    for i in range(n):
        d = rng.choice("aaabc")
        words = [rng.choice(own[d]) if rng.random() < 0.1 else "filler" + "xyz"[rng.randint(0, 2)] for _ in range(rng.randint(5, 80))]
        docs.append((i, " ".join(words), "x", 1))
        if i % 2:
            labels.append((i, d))
    return docs, labels


def test_rates_meet_the_targets_and_equal_brute_force(rows):
    docs, labels = corpus(300)
    soft, rate = M.solve(rows(docs, SCHEMA), rows(labels, "doc_id long, domain string"), TARGETS)
    out = soft.select("doc_id", "n_tokens", "p", rate.alias("rate")).orderBy("doc_id").collect()
    q, t, r = np.array([x["p"] for x in out]), np.array([x["n_tokens"] for x in out], float), np.array([x["rate"] for x in out])
    assert (r >= 0).all() and np.allclose(q.sum(1), 1)
    goal = np.array(list(TARGETS.values())) * t.sum()
    assert np.allclose((t * r) @ q, goal, rtol=1e-3)
    # the same descent in plain arrays
    x = np.ones(len(t))
    have = t @ q
    scale = np.maximum(have, 1e-3 * have.sum())
    h = (q * t[:, None]).T @ q / np.sqrt(np.outer(scale, scale))
    step = 1 / np.linalg.eigvalsh(h)[-1]
    for _ in range(60):
        now = (t * x) @ q
        if np.abs(now - goal).max() <= 1e-5 * t.sum():
            break
        x = np.maximum(0, x - step * (q @ ((now - goal) / scale)))
    assert np.allclose(x, r, atol=1e-6)


def test_posteriors_tell_domains_apart(rows):
    docs, labels = corpus(300)
    true = dict(labels)
    fit = M.learn(rows(docs, SCHEMA), rows(labels, "doc_id long, domain string"), tuple(TARGETS))
    out = M.posteriors(rows(docs, SCHEMA), fit).collect()
    hit = [list(TARGETS)[int(np.argmax(r["p"]))] == true[r["doc_id"]] for r in out if r["doc_id"] in true]
    assert np.mean(hit) > 0.8


def test_native_plan(rows, spark):
    docs, labels = corpus(40)
    soft, rate = M.solve(rows(docs, SCHEMA), rows(labels, "doc_id long, domain string"), TARGETS)
    plan = M.posteriors(rows(docs, SCHEMA), M.learn(rows(docs, SCHEMA), rows(labels, "doc_id long, domain string"), tuple(TARGETS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_an_unreachable_target_gives_zero_rates_not_negative_ones(rows):
    docs, labels = corpus(200)
    soft, rate = M.solve(rows(docs, SCHEMA), rows(labels, "doc_id long, domain string"), {"a": 0.0, "b": 0.0, "c": 1.0})
    out = soft.select("p", rate.alias("rate")).collect()
    assert all(r["rate"] >= 0 for r in out)
    assert np.mean([r["rate"] for r in out if r["p"][0] > 0.9]) < 0.2


def test_nulls_repeats_and_columns(rows, spark):
    docs, labels = corpus(100)
    docs += [(3, docs[3][1], "x", 1), (None, "ant bee", "x", 1), (200, None, "x", 1), (201, "", "x", 1), (202, "123 !!", "x", 1), (3, "other text", "x", 1)]
    labels += [(None, "a"), (1, None), (2, "zzz")]
    frame, known = rows(docs, SCHEMA), rows(labels, "doc_id long, domain string")
    out = M.mix(frame, known, TARGETS).collect()
    assert len(out) == len(docs) and all(np.isfinite(r["rate"]) for r in out)
    drawn = M.draw(frame, known, TARGETS, anchor="a")
    assert drawn.columns == ["doc_id", "text", "p", "rate"]
    kept = {r["doc_id"] for r in drawn.collect()}
    sure = {r["doc_id"] for r in M.mix(frame, known, TARGETS).collect() if r["p_a"] > 0.99}
    assert sure <= kept
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty, known, TARGETS).count() == 0 and M.draw(empty, spark.createDataFrame([], "doc_id long, domain string"), TARGETS).count() == 0
