"""Stages that turn raw documents into training tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last give the
columns of documents, and further ones that docs may have, whatever their names.

In every stage an empty table gives an empty one, and texts are taken whole.
Null ids are one id that comes last; a null source is no host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import host_rules, mixing, nearcopies, pieces, suffixes
from weftlink.llm.common import materialise
from weftlink.llm.queries import PIECES, TARGETS, domains


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and their host's verdict keep; null and empty texts go, repeated rows stay repeated."""
    return host_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8.

    It is the one of the smallest id; of repeated rows one stays, and texts
    without words all stay but for repeated rows.
    """
    return nearcopies.dedup_rows(docs, width=5, percent=80)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur elsewhere too: a passage of fifty words is longer.

    A null text becomes an empty one, and n_chars follows the text.
    """
    return suffixes.dedup_rows(docs, length=200).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.

    The total is set so that the domain of good documents keeps a tenth more
    tokens than it has: its documents stay, and some come twice.  Rows with
    the same id and text have one rate; a null text has no tokens.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.draw(docs, domains(labels), TARGETS, anchor="high")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip for each row; a null or empty text has no ids."""
    encoded = pieces.encode(docs, PIECES, check_col="round_trip", keep=["doc_id"])
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("long repeats", long_repeats),
    ("mixing", mix),
    ("encoding", tokens),
]

#: The stages are learned, drawn or iterated: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages make of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
