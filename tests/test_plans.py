import json

import pytest
from pyspark.sql import functions as F

from weftlink import __main__ as cli
from weftlink.operators import blocking
from weftlink.plans import benchmark, biz, training
from weftlink.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    left, pool = biz.sides(spark, SF)
    links = biz.true_links(spark, SF)
    return left, pool, links, training.train(left, pool, links, rounds=4)


def test_training_end_to_end(trained, spark, tmp_path):
    left, pool, links, model = trained
    f = model.figures
    assert 0 <= f["blocking_recall"] <= 1 and len(f["sweep"]) == 6
    assert model.threshold in [r["threshold"] for r in f["sweep"]]
    training.save(model, str(tmp_path))
    assert json.loads((tmp_path / "feature_schema.json").read_text())["optimal_threshold"] == model.threshold
    rows = training.resolve(model, left, pool)
    assert rows.count() == left.count()
    with pytest.raises(AssertionError):
        training.check(model, least_recall=1.1)


def test_component_split_shares_nothing(trained, spark):
    left, pool, links, _ = trained
    split = training.split_components(left, links)
    assert split.count() == left.count()
    assert training.pool_overlap(links.select("s1_id", "cand_id"), split).first()["n_shared"] == 0


def test_benchmark_has_all_paradigms(spark):
    out = benchmark.compare(tables.synthetic_pairs(spark, 150)).collect()
    assert {(r["paradigm"], r["slice"]) for r in out} == {(p, s) for p in ("marginal", "by label", "weighted", "optimised") for s in ("all", "shifted", "usual")}
    by = {r["paradigm"]: r for r in out if r["slice"] == "all"}
    assert by["by label"]["coverage_0"] > 0.93 and by["marginal"]["coverage"] > 0.9


def test_command_line(spark, tmp_path, capsys):
    rows = {1: "S1-1\tAcme Corp\tx 75001\tus\nS1-2\tOther\t\tus\n", 2: "S2-1\tAcme Corporation\t\tus\n", 3: "S3-1\tACME corp\ty\tus\n"}
    for n, body in rows.items():
        (tmp_path / f"test_source{n}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + body)
    cli.run_rules(spark, str(tmp_path), str(tmp_path / "out"))
    m, c = (next((tmp_path / "out" / d).glob("part-*")) for d in ("matching_results", "candidate_pairs"))
    assert m.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"
    assert cli.validate(spark, str(m), str(c), str(tmp_path), True)
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS9-1\n")
    assert not cli.validate(spark, str(bad), None, str(tmp_path), False)
    assert "wrong_prefix" in capsys.readouterr().out
    assert blocking.canonical(tables.read_records(spark, str(tmp_path / "test_source1.tsv")), native=False).where(F.col("key") == "acmecorp").count() == 1
