"""Rules that output lists must keep, as one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _offenders(rule: str, severity: str, rows: DataFrame, name: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), name.cast("string").alias("x"))


def _report(found: DataFrame, rules: list[tuple[str, str]], most: int = 5) -> DataFrame:
    """rule, severity, n_offenders, examples: distinct offenders are counted, and only the first few of a rule brought together."""
    each = found.where(F.col("x").isNotNull()).distinct()
    counted = each.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("rule").orderBy("x"))
    few = each.withColumn("place", place).where(F.col("place") <= most).groupBy("rule").agg(F.concat_ws(",", F.array_sort(F.collect_list("x"))).alias("few"))
    names = found.sparkSession.createDataFrame(rules, "rule string, severity string")
    out = names.join(counted, "rule", "left").join(few, "rule", "left")
    return out.select("rule", "severity", F.coalesce("n", F.lit(0)).alias("n_offenders"), F.coalesce("few", F.lit("")).alias("examples"))


def parsed(lines: DataFrame) -> DataFrame:
    """s1_id, ids, has_tab from the value column of raw lines without their header."""
    body = F.expr("substring(value, instr(value, '\t') + 1)")
    tab = F.instr("value", "\t") > 0
    ids = F.when(tab & (F.btrim(body) != ""), F.split(body, ",")).otherwise(F.array().cast("array<string>"))
    return lines.where(tab | (F.btrim("value") != "")).select(F.when(tab, F.split_part("value", F.lit("\t"), F.lit(1))).otherwise(F.col("value")).alias("s1_id"), ids.alias("ids"), tab.alias("has_tab"))


def rules(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """rule, severity, n_offenders, examples (the first five, joined).

    rows: s1_id, ids and, if raw, has_tab.  required: s1_id.  valid: ids that
    may be listed; without it unknown ids aren't looked for.
    """
    if "has_tab" not in rows.columns:
        rows = rows.withColumn("has_tab", F.lit(True))
    good = rows.where("has_tab")
    listed = good.select("s1_id", F.explode("ids").alias("id"))
    known = listed.where(F.col("id").startswith("S2-") | F.col("id").startswith("S3-"))
    seen = good.select("s1_id").distinct()
    report = [
        _offenders("no_tab", "error", rows.where(~F.col("has_tab")), F.col("s1_id")),
        _offenders("duplicate_row", "error", good.groupBy("s1_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), F.col("s1_id")),
        _offenders("repeated_id", "error", good.where(F.size("ids") != F.size(F.array_distinct("ids"))), F.col("s1_id")),
        _offenders("self_match", "error", listed.where(F.col("id").startswith("S1-")), F.col("id")),
        _offenders("wrong_prefix", "error", listed.where(~F.col("id").startswith("S1-") & ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")), F.col("id")),
        _offenders("missing_row", "error", required.select("s1_id").join(seen, "s1_id", "left_anti"), F.col("s1_id")),
        _offenders("extra_row", "error", seen.join(required.select("s1_id"), "s1_id", "left_anti"), F.col("s1_id")),
    ]
    if valid is not None:
        report.append(_offenders("unknown_id", "error", known.join(valid.select(F.col("entity_id").alias("id")), "id", "left_anti"), F.col("id")))
    names = ["no_tab", "duplicate_row", "repeated_id", "self_match", "wrong_prefix", "missing_row", "extra_row", *["unknown_id"] * (valid is not None)]
    return _report(reduce(DataFrame.unionByName, report), [(n, "error") for n in names])


def subset_warning(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records with a match that isn't among their candidates, as a warning."""
    both = matches.select("s1_id", F.col("ids").alias("m")).join(candidates.select("s1_id", F.col("ids").alias("c")), "s1_id", "left")
    outside = both.where(F.size(F.array_except("m", F.coalesce("c", F.array().cast("array<string>")))) > 0)
    return _report(_offenders("match_outside_candidates", "warning", outside, F.col("s1_id")), [("match_outside_candidates", "warning")])


def header_problem(line: str | None, expected: tuple[str, ...]) -> str | None:
    """What is wrong with a header line, None if nothing is."""
    if not line:
        return "the file is empty"
    if "\t" not in line and "," in line:
        return "columns are separated by commas, not tabs"
    if tuple(c.strip().lower() for c in line.rstrip("\n").split("\t")) != expected:
        return "the header isn't " + ", ".join(expected)
    return None


def passed(report: DataFrame) -> bool:
    return report.where((F.col("severity") == "error") & (F.col("n_offenders") > 0)).isEmpty()
