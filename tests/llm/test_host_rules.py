import re
from collections import Counter

from weftlink.llm import host_rules as H

SCHEMA = "doc_id long, text string, source string, host string, n_words string, kept int"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", " \n\t ", "one", "a b c d e a b c d e f", "x " * 50, "line\nline\n\nline\n", "é# <b> *** 漢字 z", "a b c d e f g h i j k l " * 2, " lead\x0bmid\x0cend ", "w" * 20000]


def test_counts_equal_brute_force(rows):
    data = [(i, t, "s", "h", "n", 1) for i, t in enumerate(TEXTS)]
    for r in H.rule_counts(rows(data, SCHEMA)).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(TEXTS[r["doc_id"]])


GOOD = "these are twelve quite different words that make one good clean text"


def test_a_bad_host_takes_its_documents_along(rows):
    data = [(i, "bad", "junk", "", "", 0) for i in range(95)] + [(100 + i, GOOD, "junk", "", "", 0) for i in range(5)]
    data += [(200 + i, GOOD if i % 20 else "bad", f"h{i % 4}", "", "", 0) for i in range(200)]
    data += [(900, GOOD, None, "", "", 0), (None, GOOD, "h1", "", "", 0), (900, GOOD, None, "", "", 0)]
    judged = H.host_rules(rows(data, SCHEMA)).collect()
    assert len(judged) == len(data)
    assert not any(r["kept"] for r in judged if r["host"] == "junk")
    assert all(r["kept"] != r["base_failed"] for r in judged if r["host"] != "junk")
    kept = H.keep_good(rows(data, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept.count() == sum(r["kept"] for r in judged)


def test_shrinking(spark):
    hosts = spark.createDataFrame([(100, 10), (100, 12), (100, 8), (2, 2)], "n long, failed long")
    mean, strength = H.beta_prior(hosts)
    assert abs(mean - 32 / 302) < 1e-12 and strength >= 1
    assert (2 + mean * strength) / (2 + strength) < 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.host_rules(empty).count() == 0 and H.keep_good(empty).count() == 0
