import numpy as np
from pyspark.sql import functions as F

from weftlink.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        near = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in near]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def frame(rows, ids, x):
    return rows([(int(i), [float(c) for c in v], "x", 1) for i, v in zip(ids, x, strict=True)], SCHEMA)


def test_recall_against_brute_force(rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    ids = rng.permutation(5000)[:1500]
    got = found(N.search(frame(rows, ids, x), F.col("vec_id") % 20 == 0, chunk=400, n_queries=16))
    want = brute(ids, x.astype(float), 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    scores = {q: dict(w) for q, w in brute(ids, x.astype(float), 1499, 20).items()}
    assert all(s == scores[q][v] for q in got for v, s in got[q])
    assert all(len(v) == 20 and [s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in got.values())


def test_many_copies_of_one_vector(rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[:250] = x[0]
    ids = rng.permutation(600)
    got, want = found(N.search(frame(rows, ids, x), F.col("vec_id") % 20 == 0)), brute(ids, x.astype(float), 20, 20)
    hot = [int(i) for i in ids[:250] if i % 20 == 0]
    assert hot and all(got[q] == want[q] for q in hot)


def test_repeated_rows_take_no_places(rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    x[5:31] = x[5]
    ids = np.arange(40)
    want = brute(ids, x.astype(float), 20, 20)
    again = np.r_[ids, np.full(30, 5)]
    assert found(N.search(frame(rows, again, x[again]), F.col("vec_id") % 20 == 0)) == want
    twice = np.r_[ids, ids]
    assert found(N.search(frame(rows, twice, x[twice]), F.col("vec_id") % 20 == 0)) == want


def test_one_id_with_many_near_vectors_takes_one_place(rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:] = x[0] * 3 + rng.normal(size=(300, 8)) / 100
    ids = np.r_[np.arange(100), np.full(300, 1001)]
    got = found(N.search(frame(rows, ids, x), F.col("vec_id") == 0, n_pivots=16, post=16))[0]
    scores = {}
    for i, s in zip(ids[1:], (x[1:].astype(float) * x[0].astype(float)).sum(1), strict=True):
        scores[int(i)] = max(s, scores.get(int(i), s))
    want = sorted(scores.items(), key=lambda a: (-a[1], a[0]))[:20]
    assert [v for v, _ in got] == [v for v, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_few_rows_are_all_found(rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 8)).astype(np.float32)
    ids = np.arange(12) * 10
    assert found(N.search(frame(rows, ids, x), F.col("vec_id") % 20 == 0)) == brute(ids, x.astype(float), 20, 20)


def test_what_takes_no_part(rows, spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 2.0]
    data = [(0, good), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, good), (8, [1.0, 1.0, 1.0]), (1, [2.0, 1.0]), (20, [-1.0, 0.5])]
    df = rows([(i, v, "x", 1) for i, v in data], SCHEMA)
    got = found(N.search(df, F.col("vec_id") % 20 == 0))
    assert {q: [v for v, _ in r] for q, r in got.items()} == {0: [1, 20], 20: [0, 1]}
    empty = spark.createDataFrame([], SCHEMA)
    assert N.search(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert N.search(df.where("vec_id = 2"), F.lit(True)).count() == 0


def test_a_short_row_does_not_hide_the_others(rows):
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(12, 8)).astype(np.float32), np.arange(12) * 10
    data = [(int(i), [float(c) for c in v], "x", 1) for i, v in zip(ids, x, strict=True)]
    short = [(1, [1.0, 2.0, 3.0], "x", 1), (2, [2.0, 2.0, 2.0], "x", 1)]
    got = found(N.search(rows(data + short, SCHEMA), (F.col("vec_id") % 20 == 0) | (F.col("vec_id") == 1)))
    assert got == brute(ids, x.astype(float), 20, 20) | {1: [(2, 12.0)]}


def test_footrule():
    query, ranks = np.array([0, 2, 1], np.int16), np.array([[2, 0], [0, 2], [1, 1]], np.int16)
    assert N.footrule(query, ranks, 3).tolist() == [4, 0]
    assert N.footrule(query, ranks, 1).tolist() == [2, 0]  # the nearest pivot alone
