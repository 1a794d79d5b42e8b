import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink import __main__ as cli
from weftlink.functions import similarity as S
from weftlink.operators import blocking, calibration, quality, resolve, search, shift
from weftlink.plans import biz, catalogue, extras, order, training
from weftlink.sources import tables

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abcdeé 漢") for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_many_jaro_winklers_equal_one_by_one():
    rng = random.Random(0)
    a, b = words(rng, 3000), words(rng, 3000)
    a[:50] = b[:50]
    got = S.jaro_winkler_many(a, b)
    assert np.allclose(got, [S.jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], atol=1e-12)


def test_jaro_winkler_of_nulls_and_long_texts(spark):
    data = [("abc", None), (None, None), ("x" * 3000, "x" * 2999 + "y"), ("", ""), ("", "a"), ("ab", "ba")] * 3
    out = spark.createDataFrame(data, "a string, b string").select("a", "b", S.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()
    for r in out:
        assert r["s"] is None if r["a"] is None or r["b"] is None else abs(r["s"] - S.jaro_winkler_of(r["a"], r["b"])) < 1e-12


def sides(spark, seed, n):
    rng = random.Random(seed)
    names = ["ab", "abc", "abcd", "abcde", "xabcd", "xxabcdyy", "abce", "b", "", "abcdefgh", "abcdefgi", "zabc"]
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", i, rng.choice(["us", None, "fr"]), rng.choice(names), rng.choice(["75001", None, "75002"])) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, source string, pos long, country string, key string, postal string").withColumn("prefix4", F.substring("key", 1, 4))
    return rows, *blocking.split_sources(df)


def test_postal_channel_equals_all_pairs(spark):
    rows, left, pool = sides(spark, 1, 240)
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "S1" and b[1] != "S1" and a[3] and a[3] == b[3] and a[5] and a[5] == b[5] and a[4] and b[4] and (a[4][:4] == b[4][:4] or b[4] in a[4] or a[4] in b[4]):
                want.add((a[0], b[0], a[4][:5] == b[4][:5]))
    got = [(r["s1_id"], r["cand_id"], r["is_match"]) for r in resolve.shared_postal(left, pool).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_capping_a_name_before_its_join_changes_nothing(spark):
    _, left, pool = sides(spark, 2, 400)
    for most in (1, 3, 25):
        whole = resolve.cap(resolve.first_channel(resolve.exact_names(left, pool), resolve.shared_postal(left, pool), resolve.shared_prefix(left, pool)), most)
        few = resolve.candidates(left, pool, most)
        assert few.count() == whole.count() and few.exceptAll(whole.select(few.columns)).isEmpty()


def test_reports_count_all_and_name_five(spark):
    rows = spark.createDataFrame([(f"S1-{i:03}", ["S2-1", "S2-1"]) for i in range(40)] + [("S1-000", ["Q"])], "s1_id string, ids array<string>")
    out = {r["rule"]: r for r in quality.rules(rows, spark.createDataFrame([("S1-999",)], "s1_id string")).collect()}
    assert out["repeated_id"]["n_offenders"] == 40 and out["repeated_id"]["examples"] == "S1-000,S1-001,S1-002,S1-003,S1-004"
    assert out["duplicate_row"]["examples"] == "S1-000" and out["missing_row"]["examples"] == "S1-999" and out["self_match"]["n_offenders"] == 0 and out["no_tab"]["examples"] == ""


def test_later_header_lines_stay(spark, tmp_path):
    f = tmp_path / "m.tsv"
    f.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nsource1_entity_id\tmatched_entity_ids\n \nS1-2\n")
    header, lines = tables.read_lines(spark, str(f))
    assert header == "source1_entity_id\tmatched_entity_ids"
    assert [(r["s1_id"], list(r["ids"]), r["has_tab"]) for r in quality.parsed(lines).collect()] == [("S1-1", ["S2-1"], True), ("source1_entity_id", ["matched_entity_ids"], True), ("S1-2", [], False)]
    empty = tmp_path / "e.tsv"
    empty.write_text("")
    assert tables.read_lines(spark, str(empty))[0] is None


def test_unreadable_files_are_findings(spark, tmp_path, capsys):
    (tmp_path / "test_source1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tc\n")
    bad = tmp_path / "bad.tsv"
    bad.write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\xfe\n")
    assert not cli.validate(spark, str(bad), str(tmp_path / "none.tsv"), str(tmp_path), False)
    said = capsys.readouterr().out
    assert "isn't UTF-8" in said and "doesn't exist" in said and "FAIL" in said
    assert not cli.validate(spark, str(bad), None, str(tmp_path / "nowhere"), False)
    assert cli.main(["validate", "--matching", str(bad), "--test-dir", str(tmp_path)]) == 1


def test_training_reads_nothing_of_a_test_folder(spark, tmp_path):
    good, bad = tmp_path / "train", tmp_path / "test"
    for folder in (good, bad):
        folder.mkdir()
        for n in (1, 2, 3):
            (folder / f"train_source{n}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS{n}-1\ta\tb\tc\n")
        (folder / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\n")
    records, links = tables.read_training(spark, str(good))
    assert records.count() == 3 and links.count() == 2
    with pytest.raises(PermissionError):
        tables.read_training(spark, str(bad))


def test_gates_name_what_is_missing(spark, tmp_path):
    figures = {"records_in_two_splits": 0, "blocking_recall": 0.99, "log_loss": 0.1, "raw_log_loss": 0.1}
    good = training.Trained(None, 1.2, calibration.ClassQuantiles(0.1, 0.2), 0.5, figures)
    assert all(training.gates(good).values()) and not training.gates(good, folder=str(tmp_path))["artifacts"]
    for name in training.ARTIFACTS:
        tables.write_json({}, f"{tmp_path}/{name}", spark)
    assert all(training.gates(good, folder=str(tmp_path)).values()) and json.loads((tmp_path / "matcher").read_text()) == {}
    twice = training.Trained(None, 1.2, good.quantiles, 1.5, figures | {"records_in_two_splits": 2})
    with pytest.raises(AssertionError, match="splits apart, model figures"):
        training.check(twice)


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(0)
    columns = {"a": rng.normal(size=4001), "b": np.floor(rng.exponential(3, 4001)), "c": np.r_[np.zeros(4000), 9.0]}
    rows = spark.createDataFrame([(float(x), float(y), None if i % 5 == 0 else float(z)) for i, (x, y, z) in enumerate(zip(*columns.values(), strict=True))], "a double, b double, c double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    got = {(r["name"], r["prob"]): r["quantile"] for r in order.quantiles(rows, ["a", "b", "c"], probs).collect()}
    columns["c"] = columns["c"][[i for i in range(4001) if i % 5]]
    assert len(got) == 18
    for (name, p), q in got.items():
        assert abs(q - np.quantile(columns[name], p)) < 1e-9, (name, p)
    assert order.quantiles(rows.limit(0), ["a"], [0.5]).count() == 0


def test_domain_weights_equal_newton_steps(spark):
    rows, columns = catalogue._vectors(spark, SF)
    data = rows.collect()
    x = np.array([[r[c] for c in columns] for r in data])
    y = np.array([float(r["label"] < 3) for r in data])
    w, b = np.zeros(x.shape[1]), 0.0
    z = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ np.r_[w, b])))
        ridge = np.diag([1.0] * len(w) + [0.0])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ np.r_[w, b])
        w, b = w + step[:-1], b + step[-1]
    p = np.clip(1 / (1 + np.exp(-(z @ np.r_[w, b]))), 1e-4, 1 - 1e-4)
    want = np.clip(p / (1 - p) * ((y == 0).sum() / (y == 1).sum()), 0.01, 10)
    got = {r["vec_id"]: r["weight"] for r in catalogue.QUERIES["domain_weights"](spark, SF).collect()}
    assert np.allclose([got[r["vec_id"]] for r in data], want, atol=2e-3)


def test_alignment_equals_arrays(spark):
    rows, columns = catalogue._vectors(spark, SF)
    data = rows.collect()
    x, label = np.array([[r[c] for c in columns] for r in data]), np.array([r["label"] for r in data])
    s, t = x[label >= 3], x[label < 3]
    root = lambda m, power: (lambda v, e: (e * np.maximum(v, 1e-12) ** power) @ e.T)(*np.linalg.eigh(m))
    eye = 1e-4 * np.eye(x.shape[1])
    want = (s - s.mean(0)) @ root(np.cov(s.T) + eye, -0.5) @ root(np.cov(t.T) + eye, 0.5) + t.mean(0)
    got = {r["vec_id"]: [r[c] for c in columns] for r in catalogue.QUERIES["coral_transform"](spark, SF).collect()}
    ids = [r["vec_id"] for r in data if r["label"] >= 3]
    assert np.allclose([got[i] for i in ids], want, atol=1e-4)


def test_sketched_candidates_against_all_pairs(spark):
    got = {(r["s1_id"], r["cand_id"]): r["similarity"] for r in catalogue.QUERIES["minhash_candidates"](spark, SF).collect()}
    rows = biz.canon(spark, SF).collect()
    grams = {r["entity_id"]: {r["name_clean"][i : i + 3] for i in range(len(r["name_clean"]) - 2)} for r in rows}
    want = {}
    for a in rows:
        for b in rows:
            x, y = grams[a["entity_id"]], grams[b["entity_id"]]
            if a["source"] == "S1" and b["source"] != "S1" and a["country"] and a["country"] == b["country"] and x and y and len(x & y) / len(x | y) >= 0.35:
                want[a["entity_id"], b["entity_id"]] = len(x & y) / len(x | y)
    assert got.keys() <= want.keys() and all(abs(s - want[k]) < 2e-3 for k, s in got.items())
    assert len(got) >= 0.95 * len(want)


def test_damerau_and_monge_elkan_over_all_pairs(spark):
    texts = {(r["s1_id"], r["cand_id"]): (r["a_name_clean"], r["b_name_clean"]) for r in catalogue._hydrated(spark, SF).collect()}
    for r in extras.pair_damerau(spark, SF).collect():
        assert r["distance"] == S.damerau_of(*texts[r["s1_id"], r["cand_id"]])
    for r in extras.pair_monge_elkan(spark, SF).collect():
        assert abs(r["similarity"] - S.monge_elkan_of(*texts[r["s1_id"], r["cand_id"]])) < 1e-6


def test_weight_summary_of_nothing(spark):
    out = shift.weight_summary(spark.createDataFrame([], "weight double")).first()
    assert out["n"] == 0 and out["min"] is None


def test_streamed_windows_equal_those_of_the_table(spark, tmp_path):
    from weftlink.streaming.resolve import windowed_counts

    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    events.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    run = stream.writeStream.format("memory").queryName("streamed_windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert rows(spark.table("streamed_windows")) == rows(windowed_counts(events)) != []


def test_names_come_from_whole_texts(spark, tmp_path):
    wide = [" " * 300 + "Far  away" + "\n" * 250 + "words " + "x" * 60, "a" + " " * 5000 + "b", None, "", " \t\n" * 100, "é " * 90, "y" * 100000]
    rows = [(i, t, "fr", "host1") for i, t in enumerate(wide)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    names = [r["business_name"] for r in biz.records(spark, str(tmp_path)).orderBy("pos").collect()]
    assert names == [t and " ".join(t.split())[:40].strip() for t in wide]


def test_sketched_candidates_miss_no_pair(spark):
    # 7 of 20 trigrams in common: exactly 0.35
    names = ["abcdefghijklmno", "abcdefghizyxwvut", "ab", "", "Ωμέγα 10 √"]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    like = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y)) if grams(x) and grams(y) else 0.0
    assert like(*names[:2]) == 0.35
    rows = [(f"S{s}-{c}{i}", c, names[i % 5]) for i in range(60) for s in (1, 2) for c in ("fr", "de", None)]
    left, pool = (spark.createDataFrame([r for r in rows if r[0].startswith(p)], "entity_id string, country string, name_clean string") for p in ("S1", "S2"))
    got = sorted(map(tuple, search.minhash_candidates(left, pool, piece=5).collect()))
    pairs = ((a, b, like(x, y)) for a, c, x in rows for b, d, y in rows if a.startswith("S1") and b.startswith("S2") and c and c == d)
    assert got == sorted(p for p in pairs if p[2] >= 0.35) and len(got) == 2 * 5 * 12 * 12
    assert search.minhash_classes(left, pool)[0].count() == 2 * 5


def test_alike_names_in_many_shapes():
    rng = random.Random(5)
    text = lambda: "".join(rng.choices("abcé\U0001f600", k=rng.randint(3, 9)))
    x, y = [text() for _ in range(700)], [text() for _ in range(90)] + ["x" * 300]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    for width in (2, 256):
        got = {(i, j): s for i, j, s in zip(*(c.tolist() for c in search.alike(x, y, 0.35, width=width)), strict=True)}
        want = {(i, j): len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for i, a in enumerate(x) for j, b in enumerate(y)}
        assert got == {k: s for k, s in want.items() if s >= 0.35}
