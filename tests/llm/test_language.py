import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from weftlink.llm import kernels as K
from weftlink.llm import language as L

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": ["the", "ing", "er", "tion"], "bb": ["sch", "ung", "keit", "ü"], "cc": ["ción", "ar", "mente", "ñ"]}


def corpus(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang, "x"))
    return out


def test_held_out_accuracy_and_calibration(rows):
    data = corpus(400)
    docs = rows(data, SCHEMA)
    model = L.learn(docs, ~L.held_out(F.col("doc_id")), bits=12)
    assert model.languages == ("aa", "bb", "cc")
    out = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    apart = [(i, lang) for i, _, lang, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in apart]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_held_out_rule(spark):
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", L.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_undetermined_texts_and_repeats(rows, spark):
    docs = rows([*corpus(60), (900, None, "aa", ""), (901, "", "aa", ""), (902, "123 ... 🙂", "bb", ""), (903, "x" * 200000, None, ""), (None, "thething", "aa", ""), (900, None, "aa", "")], SCHEMA)
    out = L.identify(docs, L.learn(docs, F.lit(True), bits=12)).collect()
    assert len(out) == 66
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and not by[i]["accepted"] for i in (900, 901, 902))
    assert by[903]["lang_pred"] in SYLLABLES
    nothing = L.learn(docs.where("lang = 'zz'"), F.lit(True))
    assert {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(spark.createDataFrame([], SCHEMA), nothing).count() == 0


def test_scores_equal_the_plain_mean():
    texts = [b"", b"a", b"The thing", "schöne Übung".encode()]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0] + [len(t) for t in texts])
    rng = np.random.default_rng(0)
    m = L.Model(("x", "y"), rng.normal(size=(2, 1 << 10)), rng.normal(size=2), 1.3, 0.5, 10)
    got = L.scores(m, raw, at)
    for i, t in enumerate(texts):
        one = np.frombuffer(t, np.uint8)
        keys = [h for n in L.ORDERS for h in L.subwords(one, n, 10)[: max(len(one) - n + 1, 0)]]
        z = (m.table[:, keys].mean(1) if keys else np.zeros(2)) + m.bias
        assert np.allclose(got[i], L.softmax(z / 1.3))


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(5000)
    a, b = (sorted(r["id"] for r in L.sample(df.repartition(n), F.col("id"), 300).collect()) for n in (2, 7))
    assert len(a) == 300 and a == b
    assert L.sample(df, F.col("id"), 10**6).count() == 5000


def test_words_do_not_cross_texts():
    texts = [b"ab cd", b"ef", b"", b" g\th "]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, 5, 2, 0, 5])
    s, e, edge = K.words(raw, at)
    assert [raw[x:y].tobytes() for x, y in zip(s, e, strict=True)] == [b"ab", b"cd", b"ef", b"g", b"h"]
    assert edge.tolist() == [0, 2, 3, 3, 5]
