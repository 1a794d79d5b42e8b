import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from weftlink.llm import suffixes as S

SCHEMA = "doc_id long, text string, n_bytes string, k1 int"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        dead = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                dead[i : i + length] = True
        runs = int((dead & ~np.concatenate([[False], dead[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(dead.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~dead])).hexdigest()))
    return out


def corpus(seed, n, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé漢") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(length)) for _ in range(4)]
    texts = [None, "", "short", "a" * (3 * length), "ab" * length, "xyz " * length, "q" * (length - 1), "r" * length]
    for _ in range(n):
        t = " ".join(word() for _ in range(rng.randint(0, 3 * length)))
        if rng.random() < 0.6:
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t = t[: rng.randint(0, len(t))] + p[a : a + rng.randint(length // 3, 3 * length)] + t[: rng.randint(0, 40)]
        texts.append(t)
    texts += [texts[-1], texts[-1], texts[-3], texts[-2][:-5] + "changed"]
    return texts


def compare(rows, texts, length):
    got = {r["doc_id"]: r for r in S.dedup(rows([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA), length).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, length)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, (i, texts[i])


def test_removed_bytes_equal_brute_force(rows):
    for seed in range(3):
        compare(rows, corpus(seed, 40, 60), 60)
    compare(rows, corpus(9, 30, 400), 400)


def test_repeats_go_by_bytes_not_by_words(rows):
    """57 words of 399 bytes stay in both documents, as the contract fixes 400 bytes; one byte more, and they go."""
    words = "".join(f"word{i:02} " for i in range(60))
    for n, removed in ((399, 0), (400, 400)):
        out = S.dedup(rows([(i, f"{i}{words[:n]}{i}", "x", 1) for i in range(2)], SCHEMA))
        assert [r["n_removed"] for r in out.collect()] == [removed, removed]


def test_lists_are_measured_where_nothing_else_loads_pyarrow_compute(monkeypatch):
    """A new Python worker may have loaded pyarrow without it."""
    spans, at = pa.array([[0, 1], None], pa.list_(pa.int64())), np.array([0, 9, 12])
    batch = pa.RecordBatch.from_arrays([spans] * 4, [f"k{k}" for k in (S.SURE, S.BOTH, S.KNOWN, S.HIT)])
    monkeypatch.delattr(pa, "compute", raising=False)
    assert S._spans(batch, f"k{S.SURE}", at)[0].tolist() == [0]
    monkeypatch.delattr(pa, "compute", raising=False)
    assert S._dead(batch, at, 4).sum() == 5


def test_batches_of_any_size_agree(rows, monkeypatch):
    monkeypatch.setattr(S.X, "BATCH", 500)
    compare(rows, corpus(4, 40, 60), 60)


def test_repeated_and_null_ids(rows, spark):
    text = "this text is long enough to be found again " * 12
    out = S.dedup(rows([(1, text, "", 0), (1, text, "", 0), (None, "other", "", 0), (1, "mine", "", 0)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in out) == [(-1, 5, 0), (1, 4, 0), (1, len(text), len(text)), (1, len(text), len(text))]
    assert S.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_keep_their_columns_and_whole_characters(rows):
    shared = "é" * 300
    data = [(1, "x" + shared + "漢", "a", 1), (2, shared + "y", "b", 2), (3, None, "c", 3)]
    out = S.dedup_rows(rows(data, SCHEMA))
    assert out.columns == ["doc_id", "text", "n_bytes", "k1"]
    assert sorted((r["doc_id"], r["text"], r["n_bytes"], r["k1"]) for r in out.collect()) == [(1, "x漢", "a", 1), (2, "y", "b", 2), (3, "", "c", 3)]


def test_hot_right_sides_are_compared_window_by_window(rows, monkeypatch):
    for sides, most in ((1, 4096), (8, 2)):
        monkeypatch.setattr(S, "SIDES", sides)
        monkeypatch.setattr(S, "MOST", most)
        compare(rows, corpus(5, 50, 60), 60)


def test_corpus_order_is_that_of_the_suffixes():
    """Pieces of a small text, each from before its first trigger on, against sorted suffixes."""
    rng, length = random.Random(1), 60
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    pieces, sentences = [], [[rng.choice(words) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    for _ in range(200):
        text = " ".join(w for _ in range(3) for w in rng.choice(sentences)).encode()
        raw, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        t, _ = S.triggers(raw, at, S.K.prefix_sums(S.K.BYTE[0][raw], 0), length)
        for before, here in zip([-1, *t[:-1].tolist()], t.tolist(), strict=True):
            first, last = max(before + 1, here - 45), min(here, len(text) - length)
            if first <= last:
                pieces.append(text[first : last + length])
    assert len(pieces) > 500
    piece, start, alike = S.corpus_order(pieces, length)
    found = [pieces[p][s:] for p, s in zip(piece.tolist(), start.tolist(), strict=True)]
    assert sorted((p, s) for p, s in zip(piece.tolist(), start.tolist(), strict=True)) == [(i, k) for i, p in enumerate(pieces) for k in range(len(p) - length + 1)]
    whole = Counter(w[:length] for w in found)
    runs = [w[:length] for w, a in zip(found, alike.tolist(), strict=True) if not a]
    assert len(runs) == len(whole) and max(whole.values()) > 1  # equal windows stand side by side, once
    phrases = S.phrases(pieces[0], [7, 19])
    assert phrases == [pieces[0][: 7 + S.TRIGGER], pieces[0][7 : 19 + S.TRIGGER], pieces[0][19:]]


def test_a_very_long_text(rows):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    data = [text + text[1000:2000], "z" * 50 + text[5000:5600], text[::-1]]
    out = {r["doc_id"]: r for r in S.dedup(rows([(i, t, "", 0) for i, t in enumerate(data)], SCHEMA)).collect()}
    assert (out[0]["n_removed"], out[0]["n_spans"]) == (1000 + 1000 + 600 - 0, 3) and (out[1]["n_removed"], out[2]["n_removed"]) == (600, 0)


def test_hashing_a_batch_takes_few_bytes_for_each_byte_of_text():
    """At most 60, of which the sums of two hashes and their powers take 32; the hashes are those of the definition."""
    raw = np.random.default_rng(3).integers(97, 123, 1 << 20, dtype=np.uint8)
    S.K.tidy()
    tracemalloc.start()
    sums, other = S.K.byte_sums(raw, 0), S.K.byte_sums(raw, 1)
    t, _ = S.triggers(raw, np.array([0, len(raw)]), sums, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(raw)
    for which, found in enumerate((sums, other)):
        at = np.array([0, 5, S.K.PART - 3, S.K.PART, len(raw) - 40])
        plain = [sum(int(S.K.BYTE[which][c]) * pow(S.K.BASES[which], i, 1 << 64) for i, c in enumerate(raw[a : a + 40].tolist())) % (1 << 64) for a in at.tolist()]
        assert (S.K.spans(found, at, at + 40, which) == S.K.mixed(np.array(plain, S.K.U64))).all()
    whole = S.K.rolling(sums, S.TRIGGER) % S.K.U64(25) == 0
    assert (t == np.flatnonzero(whole)).all()
