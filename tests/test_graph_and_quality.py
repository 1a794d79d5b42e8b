import random

import pytest
from pyspark.sql import functions as F

from weftlink.operators import graph as G
from weftlink.operators import matcher as MM
from weftlink.operators import quality as Q
from weftlink.operators import search as SE
from weftlink.sources import tables as ST

EDGES = "u string, v string, prob double, labels array<int>"


def clusters(spark, nodes, edges, **options):
    found = G.constrained_clusters(spark.createDataFrame([(n,) for n in nodes], "entity_id string"), spark.createDataFrame(edges, EDGES), **options)
    return found


def matches(spark, nodes, edges):
    left = spark.createDataFrame([(n,) for n in nodes if n.startswith("S1-")], "s1_id string")
    return {r["s1_id"]: r["matches"] for r in G.cluster_matches(clusters(spark, nodes, edges), left).collect()}


def test_conflicting_triangle(spark):
    edges = [("S1-00100", "S2-00200", 0.94, [1]), ("S2-00200", "S3-00300", 0.89, [1]), ("S1-00100", "S3-00300", 0.04, [0])]
    assert matches(spark, ["S1-00100", "S2-00200", "S3-00300"], edges) == {"S1-00100": ["S2-00200"]}


def test_singleton_and_empty_set(spark):
    assert matches(spark, ["S1-1", "S2-1", "S3-1"], [("S1-1", "S2-1", 0.35, [0]), ("S1-1", "S3-1", 0.55, [0, 1])]) == {"S1-1": []}
    assert matches(spark, ["S1-1", "S2-1"], [("S1-1", "S2-1", 0.9, [])]) == {"S1-1": ["S2-1"]}


def test_unknown_nodes_are_an_error(spark):
    with pytest.raises(KeyError):
        clusters(spark, ["S1-1"], [("S1-1", "S2-1", 0.9, [1])])


def test_clusters_equal_one_global_greedy_pass(spark):
    rng = random.Random(0)
    nodes = [f"S{1 + i % 3}-{i}" for i in range(60)]
    edges = {}
    for _ in range(130):
        u, v = sorted(rng.sample(nodes, 2))
        edges[u, v] = (u, v, round(rng.random(), 4), rng.choice([[0], [1], [0, 1], []]))
    edges = list(edges.values())
    apart = {frozenset(e[:2]) for e in edges if e[3] == [0]}
    home = {n: {n} for n in nodes}
    for u, v, p, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if s != [0] and p >= 0.5 and home[u] is not home[v] and not any(frozenset((a, b)) in apart for a in home[u] for b in home[v]):
            both = home[u] | home[v]
            for x in both:
                home[x] = both
    want = {tuple(sorted(c)) for c in home.values()}
    got = {tuple(r["members"]) for r in clusters(spark, nodes, edges, threshold=0.5).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r["node"]: r["component"] for r in G.connected_components(edges).collect()}
    assert {got[f"n{i:03d}"] for i in range(121)} == {"n000"} and got["y"] == "x" and got["z"] == "z"


FAULTS = ["S1-1\tS2-1,S2-1", "S1-1\t", "no tab here", "S1-2\tS1-3,X9-1,S2-404", "S1-9\tS3-1", ""]


def test_rules_name_their_offenders(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(FAULTS) + "\n")
    header, lines = ST.read_lines(spark, str(path))
    assert Q.header_problem(header, ("source1_entity_id", "matched_entity_ids")) is None
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    valid = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    report = Q.rules(Q.parsed(lines), required, valid)
    got = {r["rule"]: (r["n_offenders"], r["examples"]) for r in report.collect()}
    assert got == {
        "no_tab": (1, "no tab here"),
        "duplicate_row": (1, "S1-1"),
        "repeated_id": (1, "S1-1"),
        "self_match": (1, "S1-3"),
        "wrong_prefix": (1, "X9-1"),
        "missing_row": (1, "S1-3"),
        "extra_row": (1, "S1-9"),
        "unknown_id": (1, "S2-404"),
    }
    assert not Q.passed(report)


def test_headers():
    want = ("a", "b")
    assert Q.header_problem("A\tb\n", want) is None
    assert "commas" in Q.header_problem("a,b", want) and "empty" in Q.header_problem("", want) and "isn't" in Q.header_problem("b\ta", want)


def test_tables_survive_a_round_trip(spark, tmp_path):
    src = tmp_path / "s.tsv"
    src.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-2\t"Acme" NA\t\tus\nS1-10\tnull\tx\t\n')
    rows = {r["entity_id"]: r for r in ST.read_records(spark, str(src)).collect()}
    assert rows["S1-2"]["business_name"] == '"Acme" NA' and rows["S1-2"]["business_address"] is None
    assert rows["S1-10"]["business_name"] == "null" and rows["S1-10"]["country"] is None and rows["S1-10"]["pos"] == 10
    lists = spark.createDataFrame([("S1-2", 2, ["S2-1", "S3-1"]), ("S1-10", 10, [])], "s1_id string, pos long, m array<string>")
    ST.write_lists(lists, str(tmp_path / "out"), "m", "matched_entity_ids")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-2\tS2-1,S3-1\nS1-10\t\n"
    assert {(r["s1_id"], r["cand_id"]) for r in ST.read_truth(spark, str(tmp_path / "out")).collect()} == {("S1-2", "S2-1"), ("S1-2", "S3-1")}
    with pytest.raises(PermissionError):
        ST.guarded("/data/test/x.tsv")
    assert ST.guarded("/data/train/x.tsv")
    assert {r["entity_id"] for r in ST.read_ids(spark, str(src)).collect()} == {"S1-2", "S1-10"}
    assert ST.read_targets(spark, str(tmp_path)) is None
    ST.write_json({"a": 1}, str(tmp_path / "j" / "x.json"))


def test_synthetic_pairs_do_not_depend_on_partitions(spark):
    a = ST.synthetic_pairs(spark, 50)
    n = a.groupBy("source1_id").count()
    assert n.where("count < 15 or count > 24").isEmpty()
    key = ["source1_id", "candidate_id", "raw_logit", "label"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, ST.synthetic_pairs(spark, 50).repartition(7).select(*key).collect()))


def test_matcher_learns(spark):
    rows = ST.synthetic_pairs(spark, 60)
    names = ["name_sim", "addr_sim", "token_jaccard"]
    model = MM.fit(rows, names, rounds=5)
    out = MM.logits(model, rows, names)
    hi, lo = (out.where(f"label = {y}").agg({"logit": "avg"}).first()[0] for y in (1, 0))
    assert hi > 0 > lo
    MM.audit({"fine": True})
    with pytest.raises(AssertionError):
        MM.audit({"bad": False})


def test_nearest_by_brute_force(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["rank"]) for r in SE.nearest(rows.where("vec_id = 2"), rows, 2).orderBy("rank").collect()]
    assert got == [(5, 1), (4, 2)]
    whole, cut = (sorted(map(tuple, SE.nearest(rows, rows, 3, block=n).collect())) for n in (100, 2))
    assert whole == cut and len(whole) == 18


def test_scored_pairs_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    score = F.udf(lambda p: seen.add(1) or p, "double").asNondeterministic()
    edges = spark.createDataFrame([("a", "b", 0.9, [1]), ("b", "c", 0.85, [1]), ("a", "c", 0.1, [0])], EDGES)
    found = G.constrained_clusters(spark.createDataFrame([(n,) for n in "abcd"], "entity_id string"), edges.withColumn("prob", score("prob")))
    assert sorted(r["members"] for r in found.collect()) == [["a", "b"], ["c"], ["d"]] and seen.value == 3


def test_matches_are_listed_once_a_cluster(spark):
    rows = spark.createDataFrame([("S1-1", ["S1-1", "S1-2", "S2-3", "S3-4", "S2-3"]), ("S1-5", ["S1-5"])], "cluster_id string, members array<string>")
    out = G.cluster_matches(rows, spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-5",), ("S1-6",)], "s1_id string"))
    assert sorted(map(tuple, out.collect())) == [("S1-1", ["S2-3", "S3-4"]), ("S1-2", ["S2-3", "S3-4"]), ("S1-5", []), ("S1-6", [])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("lambdafunction")  # the members are sifted below the explosion
