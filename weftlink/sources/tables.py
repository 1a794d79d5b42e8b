"""Readers and writers of the library's tables."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import list_items
from ..plans.lists import joined

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def guarded(path: str, forbidden: str = "test") -> str:
    """The path, unless one of its parts is the forbidden one."""
    logging.getLogger(__name__).info("reading %s", path)
    if forbidden in Path(path).parts:
        raise PermissionError(f"{path} isn't to be read here")
    return path


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, forbidden: str | None = None) -> DataFrame:
    """Tab-separated rows with a header: quotes are plain characters, empty fields null, short rows kept.

    forbidden: a folder or file name that the path may not contain, as for training data.
    """
    return spark.read.csv(guarded(path, forbidden) if forbidden else path, sep="\t", header=True, quote="", schema=schema, mode="PERMISSIVE")


def read_records(spark: SparkSession, path: str, forbidden: str | None = None) -> DataFrame:
    """Records with source and pos; pos orders records by id, numbers in ids by value."""
    df = read_tsv(spark, path, RECORDS, forbidden)
    number = F.coalesce(F.try_to_number(F.split_part("entity_id", F.lit("-"), F.lit(2)), F.lit("9" * 18)).cast("long"), F.lit(0))
    return df.withColumn("source", F.split_part("entity_id", F.lit("-"), F.lit(1))).withColumn("pos", number)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("pos", "entity_id").limit(n)


def read_training(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records of the three training sources, and their true links; nothing of a test set is read."""
    parts = [read_records(spark, f"{folder}/train_source{n}.tsv", "test") for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), read_truth(spark, f"{folder}/train_ground_truth.tsv", "test")


def read_truth(spark: SparkSession, path: str, forbidden: str | None = None) -> DataFrame:
    """s1_id, cand_id for each listed match."""
    df = read_tsv(spark, path, TRUTH, forbidden)
    return df.select(F.col("source1_entity_id").alias("s1_id"), F.explode(list_items(F.col("matched_entity_ids"))).alias("cand_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct first column, without header and blank lines."""
    lines = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return lines.select(F.btrim(F.col(lines.columns[0])).alias("entity_id")).where(F.col("entity_id") != "").distinct()


def read_targets(spark: SparkSession, folder: str, names=("test_source2.tsv", "test_source3.tsv")) -> DataFrame | None:
    """All ids of the sources to match with; None if a file is missing."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    found = []
    for name in names:
        try:
            found.append(read_ids(spark, f"{folder}/{name}"))
        except (AnalysisException, Py4JError):
            return None
    return found[0].unionByName(found[1]).distinct()


def read_lines(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """The header line, None for an empty file, and the other lines as value.

    The header is the first line by its place, so later lines equal to it stay; blank lines go.
    """
    lines = spark.read.csv(path, sep="\x01", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if not lines.columns:
        return None, spark.read.text(path)
    return lines.columns[0], lines.toDF("value", *lines.columns[1:]).select("value")


def file_problem(spark: SparkSession, path: str) -> str | None:
    """What keeps a file from being read as lines of text, None if nothing does."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return "the file doesn't exist"
    return None if lines.where(~F.is_valid_utf8("value")).isEmpty() else "the file isn't UTF-8"


def write_lists(rows: DataFrame, path: str, column: str, header: str) -> None:
    """One tab-separated file of id lists in the order of pos; an empty list is an empty field."""
    out = rows.select("pos", F.col("s1_id").alias("source1_entity_id"), joined(F.col(column)).alias(header))
    out.orderBy("pos", "source1_entity_id").drop("pos").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def exists(path: str, spark: SparkSession | None = None) -> bool:
    """Whether a path exists in the file system that it names."""
    spark = spark or SparkSession.getActiveSession()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_json(value: dict, path: str, spark: SparkSession | None = None) -> None:
    """A JSON file in the file system that the path names, so that a cluster's shared folder works too."""
    spark = spark or SparkSession.getActiveSession()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def synthetic_pairs(spark: SparkSession, n: int = 4000, seed: int = 42) -> DataFrame:
    """Scored pairs for benchmarks: 15 to 24 candidates for each record, 15 % of records without a match, 15 % from the shifted domain.

    All columns follow from hashes of the ids, so any run and any partitioning
    gives the same rows.
    """
    u = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda name: F.sqrt(-2 * F.log(u(F.lit(name), "e", "c"))) * F.cos(6.283185307179586 * u(F.lit(name + "'"), "e", "c"))
    rows = spark.range(n).withColumnRenamed("id", "e")
    rows = rows.withColumn("k", (15 + F.floor(10 * u(F.lit("k"), "e"))).cast("int")).withColumn("single", u(F.lit("s"), "e") < 0.15).withColumn("shifted", u(F.lit("d"), "e") < 0.15)
    rows = rows.withColumn("m", F.when(F.col("single"), 0).otherwise(1 + F.floor(3 * u(F.lit("m"), "e")).cast("int"))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    label = (F.col("c") < F.col("m")).cast("int")
    sim = lambda name, hi, lo: F.least(F.greatest(F.when(label == 1, F.lit(hi)).otherwise(F.lit(lo)) + 0.12 * normal(name) - 0.05 * F.col("shifted").cast("int"), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("label", label).withColumn("name_sim", sim("n", 0.85, 0.35)).withColumn("addr_sim", sim("a", 0.8, 0.3)).withColumn("token_jaccard", sim("t", 0.75, 0.25))
    logit = 9 * F.col("name_sim") + 6 * F.col("addr_sim") + 5 * F.col("token_jaccard") - 11.5 + 0.8 * normal("z")
    return rows.select(
        F.concat(F.lit("C"), "e").alias("cluster_id"),
        F.concat(F.lit("S1-"), "e").alias("source1_id"),
        F.concat(F.when(F.col("c") % 2 == 0, "S2-").otherwise("S3-"), F.col("e") * 100 + F.col("c")).alias("candidate_id"),
        F.when(F.col("shifted"), "France").when(F.col("e") % 2 == 0, "US").otherwise("India").alias("country"),
        F.col("shifted").cast("int").alias("is_target_domain"),
        "name_sim",
        "addr_sim",
        "token_jaccard",
        logit.alias("raw_logit"),
        "label",
    )
