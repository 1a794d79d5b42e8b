import hashlib
import random
import re

from weftlink.llm import passages as P

SCHEMA = "doc_id long, text string, n_words string, k2 int"


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = []
    for d, w in enumerate(words):
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (d, i) for p in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(seed, n, window):
    rng = random.Random(seed)
    vocabulary = ["aa", "b", "ccc", "Dé", "漢", "e.", "f", "g", "h", "i"]
    words = lambda k: [rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(k)]
    shared = [words(3 * window) for _ in range(3)]
    texts = [None, "", " \n ", "one", "w " * (5 * window), "u v " * (3 * window)]
    for _ in range(n):
        t = words(rng.randint(0, 4 * window))
        if rng.random() < 0.7:
            s = rng.choice(shared)
            a = rng.randint(0, window)
            t[len(t) // 2 : len(t) // 2] = s[a : a + rng.randint(window // 2, 2 * window)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    return [*texts, texts[-1], texts[-2], texts[7]]


def compare(rows, texts, window):
    got = {r["doc_id"]: r for r in P.dedup(rows([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA), window).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, window)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"], got[i]["text"]) == want, i


def test_removed_words_equal_brute_force(rows):
    for seed in range(3):
        compare(rows, corpus(seed, 40, 20), 20)
    compare(rows, corpus(5, 40, 6), 6)


def test_batches_of_any_size_agree(rows, monkeypatch):
    monkeypatch.setattr(P.X, "BATCH", 400)
    compare(rows, corpus(6, 40, 20), 20)


def test_repeated_and_null_ids(rows, spark):
    text = " ".join(f"word{i}" for i in range(30))
    out = P.dedup(rows([(5, text, "", 0), (5, text, "", 0), (None, text, "", 0), (7, text, "", 0)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in out) == [(5, 0), (5, 0), (7, 30), (99, 30)]
    assert P.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
