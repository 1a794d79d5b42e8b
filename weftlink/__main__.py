"""python -m weftlink resolve|validate: the rules and the output checks from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import blocking, quality, resolve
from .sources import tables

HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidate": ("source1_entity_id", "candidate_entity_ids")}


def run_rules(spark: SparkSession, folder: str, out: str, prefix: str = "test_source") -> None:
    """Resolve three sources and write both list files."""
    records = None
    for n in (1, 2, 3):
        one = tables.read_records(spark, f"{folder}/{prefix}{n}.tsv")
        records = one if records is None else records.unionByName(one)
    left, pool = blocking.split_sources(blocking.canonical(records, native=False))
    rows = resolve.repaired(resolve.resolved(left, resolve.candidates(left, pool)))
    tables.write_lists(rows, f"{out}/matching_results", "matches", HEADERS["matching"][1])
    tables.write_lists(rows, f"{out}/candidate_pairs", "candidates", HEADERS["candidate"][1])


def validate(spark: SparkSession, matching: str, candidate: str | None, folder: str, check_ids: bool) -> bool:
    """Print all problems; True if there are no errors."""
    if problem := tables.file_problem(spark, source := f"{folder}/test_source1.tsv"):
        print(f"error: {source}: {problem}\nFAIL")
        return False
    required = tables.read_ids(spark, source).withColumnRenamed("entity_id", "s1_id")
    valid = tables.read_targets(spark, folder) if check_ids else None
    if check_ids and valid is None:
        print("warning: a source to match with is missing, so ids aren't looked up")
    good, parsed = True, {}
    for name, path in (("matching", matching), ("candidate", candidate)):
        if path is None:
            print("warning: no candidate file")
            continue
        if problem := tables.file_problem(spark, path):
            print(f"error: {path}: {problem}")
            good = False
            continue
        header, lines = tables.read_lines(spark, path)
        if problem := quality.header_problem(header, HEADERS[name]):
            print(f"error: {path}: {problem}")
            good = False
            continue
        parsed[name] = quality.parsed(lines)
        report = quality.rules(parsed[name], required, valid)
        for r in report.where(F.col("n_offenders") > 0).collect():
            print(f"{r['severity']}: {path}: {r['rule']}: {r['n_offenders']}, e.g. {r['examples']}")
        good = good and quality.passed(report)
    if len(parsed) == 2:
        r = quality.subset_warning(parsed["matching"], parsed["candidate"]).first()
        if r["n_offenders"]:
            print(f"warning: {r['rule']}: {r['n_offenders']}, e.g. {r['examples']}")
    print("PASS" if good else "FAIL")
    return good


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftlink")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("resolve")
    one.add_argument("out", nargs="?", default="output")
    one.add_argument("folder", nargs="?", default="dataset/test")
    two = commands.add_parser("validate")
    two.add_argument("--matching", required=True)
    two.add_argument("--candidate")
    two.add_argument("--test-dir", default="dataset/test")
    two.add_argument("--check-ids", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("weftlink").getOrCreate()
    if args.command == "resolve":
        run_rules(spark, args.folder, args.out)
        return 0
    return 0 if validate(spark, args.matching, args.candidate, args.test_dir, args.check_ids) else 1


if __name__ == "__main__":
    sys.exit(main())
