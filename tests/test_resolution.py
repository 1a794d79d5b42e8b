import pytest
from pyspark.sql import functions as F

from weftlink.operators import blocking as B
from weftlink.operators import features as X
from weftlink.operators import resolve as R
from weftlink.streaming import resolve as SR

SCHEMA = "entity_id string, business_name string, business_address string, country string, pos long"


@pytest.fixture
def sides(spark):
    def make(data):
        rows = [(i, n, a, c, int(i.split("-")[1])) for i, n, a, c in data]
        return B.split_sources(B.canonical(spark.createDataFrame(rows, SCHEMA)))

    return make


def listed(left, pool, **options):
    rows = R.repaired(R.resolved(left, R.candidates(left, pool, **options)))
    return {r["s1_id"]: (r["matches"], r["candidates"]) for r in rows.collect()}


def test_every_record_has_one_row(sides):
    out = listed(*sides([("S1-1", "Acme Corp", "1 A 75001", "us"), ("S1-2", None, None, "us"), ("S2-1", "Acme Corporation", None, "us"), ("S3-1", "Acme Corp", None, None)]))
    assert out == {"S1-1": (["S2-1"], ["S2-1"]), "S1-2": ([], [])}


def test_an_earlier_channel_is_not_upgraded(sides):
    out = listed(*sides([("S1-1", "abcdxfgh", "x 75001", "us"), ("S2-1", "abcdyfgh", "x 75001", "us")]))
    assert out == {"S1-1": ([], ["S2-1"])}


def test_cap_in_order_of_arrival(sides):
    out = listed(*sides([("S1-1", "acme tools", "", "us"), *((f"S3-{i}", "acme tools", "", "us") for i in range(20)), *((f"S2-{i}", "acme tools", "", "us") for i in range(10))]))
    want = [f"S2-{i}" for i in range(10)] + [f"S3-{i}" for i in range(15)]
    assert out == {"S1-1": (want, want)}


def test_crowded_prefixes_are_left_out(sides):
    left = [(f"S1-{i}", f"abcdef{i:02d}", "", "us") for i in range(13)]
    assert all(not c for _, c in listed(*sides([*left, ("S2-1", "abcdef00x", "", "us")])).values())
    assert listed(*sides([*left[:12], ("S2-1", "abcdef00x", "", "us")]))["S1-0"] == (["S2-1"], ["S2-1"])


def test_partitions_do_not_matter(sides, spark):
    left, pool = sides([("S1-1", "acme tools", "", "us"), *((f"S2-{i}", "acme tools", "", "us") for i in range(40))])
    assert listed(left.repartition(1), pool.repartition(1)) == listed(left.repartition(5), pool.repartition(7))


def test_blocking_channels(sides):
    left, pool = sides([("S1-1", "alpha beta gamma", "x 75001", "us"), ("S2-1", "zeta alpha", "y", "us"), ("S2-2", "zz alpha alpha", "75001", "us"), ("S3-1", "alpine", "", "fr"), ("S3-2", "alph", "", "us")])
    pairs = lambda df: sorted(r["cand_id"] for r in df.collect())
    assert pairs(B.block_postal(left, pool)) == ["S2-2"]
    assert pairs(B.block_prefix(left, pool)) == ["S3-2"]
    assert pairs(B.block_token(left, pool)) == ["S2-1", "S2-2"]
    assert pairs(B.block_token(left, pool, most=1)) == ["S2-1"]
    union = B.union_channels(B.block_postal(left, pool), B.block_prefix(left, pool), B.block_token(left, pool))
    links = left.sparkSession.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-1", "S9-9")], "s1_id string, cand_id string")
    assert B.recall(union, links, pool).first().asDict() == {"n_links": 2, "n_found": 1, "recall": 0.5}
    assert B.fanout(union).first()["n_pairs"] == 3
    assert B.recall(union, links.limit(0), pool).first()["recall"] == 1.0
    assert {r["cand_id"] for r in B.known_links(links, pool).collect()} == {"S2-1", "S3-1"}


def test_null_countries_join_only_when_asked(sides):
    left, pool = sides([("S1-1", "acme", "", None), ("S2-1", "acme", "", None)])
    assert R.exact_names(left, pool).count() == 0
    assert R.exact_names(B.with_null_country(left), B.with_null_country(pool)).count() == 1


def test_features_with_and_without_address(sides):
    left, pool = sides([("S1-1", "Acme Corp", "12 Main 75001", "us"), ("S2-1", "Acme Corp", None, "us"), ("S3-1", "Acme Co", "21 Main 75001", "us")])
    pairs = left.sparkSession.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-1", "S2-9")], "s1_id string, cand_id string")
    out = {r["cand_id"]: r for r in X.pair_features(pairs, left.unionByName(pool)).collect()}
    assert len(out) == 2 and list(out["S2-1"].asDict())[2:] == list(X.NAMES)
    none = out["S2-1"]
    assert [none[n] for n in X.NAMES[9:16]] == [0.5, 0.5, 0.0, 0.0, 0.5, 50.0, 0.0] and none["addr_word_count_diff"] == 5.0
    assert none["name_exact_match"] == 1.0 and none["composite_similarity"] == 1.0 and none["source_is_s2"] == 1.0
    some = out["S3-1"]
    assert some["postal_exact_match"] == 1.0 and some["digit_overlap_count"] == 5.0 and some["both_have_address"] == 1.0


def test_background_keeps_what_is_needed(spark):
    pool = spark.range(100).select(F.concat(F.lit("S2-"), "id").alias("entity_id"))
    got = {r["entity_id"] for r in X.background(pool, pool.where("entity_id in ('S2-5', 'S2-6')"), 10).collect()}
    assert len(got) == 10 and {"S2-5", "S2-6"} <= got


def test_streamed_records_find_the_same_pairs(sides, spark, tmp_path):
    left, pool = sides([("S1-1", "acme tools", "", "us"), *((f"S2-{i}", "acme tools", "", "us") for i in range(30))])
    pool.write.parquet(str(tmp_path / "in"))
    found = []
    q = SR.start(left, spark.readStream.schema(pool.schema).parquet(str(tmp_path / "in")), lambda df, n: found.extend(r["cand_id"] for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(found) == sorted(f"S2-{i}" for i in range(30))


def test_streamed_cap(sides, spark, tmp_path):
    left, pool = sides([("S1-1", "acme tools", "", "us"), *((f"S2-{i}", "acme tools", "", "us") for i in range(30))])
    R.exact_names(left, pool).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(R.exact_names(left, pool).schema).parquet(str(tmp_path / "in"))
    q = SR.capped(stream).writeStream.format("memory").queryName("capped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["place"] for r in spark.table("capped").orderBy("place").collect()] == list(range(1, 26))


def test_sound_channel_has_all_pairs(spark):
    from weftlink.operators import search

    schema = "entity_id string, country string, source string, pos long, name_clean string"
    left = spark.createDataFrame([(f"S1-{i}", c, "S1", i, n) for i, (c, n) in enumerate([("fr", "robert sa"), ("fr", "rupert"), ("us", "robert"), (None, "robert"), ("fr", "")])], schema)
    pool = spark.createDataFrame([(f"S2-{i}", "fr", "S2", i, "rupert co") for i in range(50)] + [("S3-1", "us", "S3", 1, "tymczak"), ("S3-2", None, "S3", 2, "robert"), ("S3-3", "fr", "S3", 3, "")], schema)
    want = sorted((f"S1-{i}", f"S2-{j}") for i in range(2) for j in range(50))
    for options in ({}, {"chunk": 1}):
        assert sorted((r["s1_id"], r["cand_id"]) for r in search.block_sound(left, pool, **options).collect()) == want
