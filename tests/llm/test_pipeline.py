import corpus_pipeline as P

from weftlink.llm import common, mixing

from .test_host_rules import brute as rule_brute
from .test_nearcopies import brute as near_brute
from .test_suffixes import brute as byte_brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    source = docs.orderBy("doc_id").collect()
    # quality rules
    good = spark.read.parquet(_write(P.quality(spark, docs, SF), tmp_path / "1"))
    keep = [r for r in source if not ((b := rule_brute(r["text"]))[0] < 10 or 100 * b[4] > 20 * b[0])]
    assert good.columns == columns and _ids(good) == [r["doc_id"] for r in keep]
    # near copies
    near = spark.read.parquet(_write(P.near_copies(spark, good, SF), tmp_path / "2"))
    roots = near_brute([r["text"] for r in keep], 5)
    first = [r for i, (r, (n, root)) in enumerate(zip(keep, roots, strict=True)) if root == i or not n]
    assert near.columns == columns and _ids(near) == [r["doc_id"] for r in first]
    # long repeats
    cut = spark.read.parquet(_write(P.long_repeats(spark, near, SF), tmp_path / "3"))
    removed = {r["doc_id"]: b[1] for r, b in zip(first, byte_brute([r["text"] for r in first], 200), strict=True)}
    texts = {r["doc_id"]: r["text"] for r in first}
    assert cut.columns == columns and _ids(cut) == _ids(near)
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"])
        assert 0 <= len(r["text"].encode()) - (len(texts[r["doc_id"]].encode()) - removed[r["doc_id"]]) <= 6 * (removed[r["doc_id"]] > 0) * 4
    # mixing
    mixed = spark.read.parquet(_write(P.mix(spark, cut, SF), tmp_path / "4"))
    assert mixed.columns == columns
    soft, rate = mixing.solve(cut, P.domains(spark.read.parquet(f"{SF}/labels.parquet")), P.TARGETS, anchor="high")
    rates = {r["doc_id"]: r["rate"] for r in soft.select("doc_id", rate.alias("rate")).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(abs(copies.get(i, 0) - r) < 1 + 1e-9 for i, r in rates.items())
    # encoding
    out = P.tokens(spark, mixed, SF).collect()
    assert len(out) == mixed.count() and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in out)


def _write(df, path):
    df.write.parquet(str(path))
    return str(path)


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_run_and_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality rules", "near copies", "long repeats", "mixing", "encoding"]
    assert P.run(spark, SF).count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_written_tables_lie_in_the_named_folder(spark):
    df = common.materialise(spark.range(5), "test")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in df.inputFiles())
    common.forget(df)


def test_stages_take_nulls_repeats_and_any_columns(spark):
    good = "".join(f"word{i} " for i in range(30))
    data = [(1, good, "en", "a", 0), (1, good, "en", "a", 0), (None, good + "more", None, None, None), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, "other " + good[::-1], "en", None, 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["did", "uid", "key", "copies", "failed", "counts", "raw_text", "host_key", "__id"]
    from pyspark.sql import functions as F

    docs = docs.select("*", *(F.lit(c).alias(c) for c in extra))
    for _, stage in P.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF), "edge")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        assert all(r[c] == c for r in docs.collect() for c in extra)
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids <= {1, 4, None} and 4 in ids
    out = P.tokens(spark, docs, SF)
    assert out.columns[0] == "doc_id" and out.count() == docs.count()
