import random
import re

import numpy as np
import pytest

from weftlink.llm import nearcopies as N
from weftlink.llm.components import components

SCHEMA = "doc_id long, text string, n int, rep string, cid string"


def shingle_set(text, width):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(texts, width=4, percent=80):
    sets, parent = [shingle_set(t, width) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randint(0, 400)}" for _ in range(k)]
    texts = [None, "", " \n", "Alone", "alone", "two words", "Two  WORDS", "É é", "é é"]
    for _ in range(groups):
        base = words(rng.randint(4, 120))
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words(1))
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


def compare(rows, texts, **options):
    got = {r["doc_id"]: r for r in N.near_copies(rows([(i, t, 1, "", "") for i, t in enumerate(texts)], SCHEMA), **options).collect()}
    assert len(got) == len(texts)
    for i, (n, root) in enumerate(brute(texts, options.get("width", 4))):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, root, root == i), (i, texts[i])


def test_groups_equal_brute_force(rows):
    compare(rows, corpus(1, 40, 6))
    compare(rows, corpus(2, 3, 60), width=5)


def test_large_clusters_are_compared_block_by_block(rows, monkeypatch):
    old = N.links
    monkeypatch.setattr(N, "links", lambda c, s, p: old(c, s, p, block=5))
    compare(rows, corpus(3, 2, 70))


def test_long_chains_are_compared_bucket_by_bucket(rows, monkeypatch):
    rng, old, seen = random.Random(9), N.pieces_of, []

    def spied(classes, clusters):
        units = old(classes, clusters, block=4)
        seen.append((clusters.select("cluster").distinct().count(), units.select("cluster").distinct().count()))
        return units

    monkeypatch.setattr(N, "pieces_of", spied)
    line = [f"c{rng.randint(0, 5000)}" for _ in range(1200)]
    chain = [" ".join(line[i : i + 60]) for i in range(0, 1140, 12)]  # neighbours have similarity 0.65
    linked = [" ".join(["x", *line[i : i + 60]]) for i in range(0, 1140, 60)]
    compare(rows, chain + linked + corpus(4, 20, 4))
    assert seen[0][1] > seen[0][0] + 40


def test_matrix_and_pairwise_agree():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 40, 300).astype(np.uint64))
    items = [np.sort(np.unique(np.concatenate([rng.choice(base, 280, False), rng.integers(0, 1 << 40, k).astype(np.uint64)]))) for k in rng.integers(0, 60, 30)]
    block = rng.integers(0, 2, 30)
    for across in (False, True):
        found = N.joined_pairs(items, block, across, 80)
        parent = list(range(30))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(30):
            for j in range(i):
                c = len(np.intersect1d(items[i], items[j]))
                if 100 * c >= 80 * (len(items[i]) + len(items[j]) - c) and not (across and block[i] == block[j]):
                    parent[find(i)] = find(j)
        own = list(range(30))
        for i, j in found:
            while own[i] != i:
                i = own[i]
            while own[j] != j:
                j = own[j]
            own[i] = j
        root = lambda p, i: i if p[i] == i else root(p, p[i])
        assert all((root(parent, i) == root(parent, j)) == (root(own, i) == root(own, j)) for i in range(30) for j in range(30))


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 1 << 62, k).astype(np.uint64) for k in (60, 20, 20))
        sets = [np.concatenate([common, x]) for x in (a, b)]
        doc = np.repeat([0, 1], [80, 80])
        sig = N.superminhash(doc, np.concatenate(sets), 2, 128)
        errors.append((sig[0] == sig[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.6 * 0.4 / 128


def test_signature_of_nothing_and_of_one():
    sig = N.superminhash(np.array([1]), np.array([5], np.uint64), 3, 16)
    assert (sig[[0, 2]] == N._EMPTY).all() and (sig[1] != N._EMPTY).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (300, 200), (None, 1)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and found[200] == found[201] == found[300] != found[0]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_and_null_ids(rows, spark):
    text = "the same words in every one of these rows"
    data = [(4, text, 0, "", ""), (4, text, 0, "", ""), (None, text, 0, "", ""), (None, "nothing like it at all here", 0, "", ""), (9, None, 0, "", "")]
    out = N.near_copies(rows(data, SCHEMA)).collect()
    assert sorted(((r["doc_id"] or 99), (r["component_id"] or 99), r["kept"]) for r in out) == [(4, 4, True), (4, 4, True), (9, 9, True), (99, 4, False), (99, 99, True)]
    kept = N.dedup_rows(rows(data, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "rep", "cid"] and kept.count() == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert N.near_copies(empty).count() == 0 and N.dedup_rows(empty).count() == 0


@pytest.mark.parametrize("n", [1, 3, 50])
def test_one_group_of_copies(rows, n):
    compare(rows, ["a b c d e f g h"] * n)
