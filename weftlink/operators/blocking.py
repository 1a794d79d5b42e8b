"""Candidate pairs from shared keys.

Records have entity_id, source, pos, name_clean, addr_clean, postal, phonetic,
country, and for the rules key and prefix4.  Every channel is an equi-join; a
bucket that contributes its first k records only is ranked before the join, so
a hot key costs k rows on the pool's side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def canonical(records: DataFrame, native: bool = False) -> DataFrame:
    """Add all derived columns to entity_id, business_name, business_address, country, pos.

    A null country never joins; see with_null_country().
    """
    name = T.canonical_name(F.col("business_name"), native)
    key = T.name_key(F.col("business_name"), native)
    return records.select(
        "entity_id",
        T.source_of(F.col("entity_id")).alias("source"),
        "pos",
        "country",
        name.alias("name_clean"),
        T.clean_text(F.col("business_address"), native).alias("addr_clean"),
        T.postal_code(F.col("business_address")).alias("postal"),
        key.alias("key"),
    ).select("*", T.phonetic_prefix(F.col("name_clean")).alias("phonetic"), F.substring("key", 1, 4).alias("prefix4"))


def with_null_country(records: DataFrame, name: str = "nan") -> DataFrame:
    """Let records without a country join with each other."""
    return records.withColumn("country", F.coalesce("country", F.lit(name)))


def split_sources(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records to resolve, and the pool that they are resolved against."""
    return records.where(F.col("source") == "S1"), records.where(F.col("source").isin("S2", "S3"))


def arrival(*more: str) -> list:
    return ["source", "pos", "entity_id", *more]


def first_of_bucket(pool: DataFrame, keys: list[str], most: int, order: list | None = None) -> DataFrame:
    """The first ``most`` rows of each bucket in order of arrival; null keys have none."""
    for k in keys:
        pool = pool.where(F.col(k).isNotNull())
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or arrival())))
    return pool.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def block_on(left: DataFrame, pool: DataFrame, key: str, most: int, channel: str) -> DataFrame:
    """s1_id, cand_id, channel for equal (country, key)."""
    few = first_of_bucket(pool, ["country", key], most).select("country", key, F.col("entity_id").alias("cand_id"))
    return left.select("country", key, F.col("entity_id").alias("s1_id")).join(few, ["country", key]).select("s1_id", "cand_id", F.lit(channel).alias("channel"))


def block_postal(left: DataFrame, pool: DataFrame, most: int = 20) -> DataFrame:
    return block_on(left, pool, "postal", most, "postal")


def block_prefix(left: DataFrame, pool: DataFrame, most: int = 20) -> DataFrame:
    return block_on(left, pool, "phonetic", most, "prefix")


def block_token(left: DataFrame, pool: DataFrame, most: int = 15, left_first: int = 2, pool_first: int = 3) -> DataFrame:
    """Shared early words of four characters or more; a repeated word takes a place each time."""
    spread = pool.select("country", "entity_id", "source", "pos", F.posexplode(T.salient_tokens(F.col("name_clean"), pool_first)).alias("at", "token"))
    few = first_of_bucket(spread, ["country", "token"], most, arrival("at")).select("country", "token", F.col("entity_id").alias("cand_id"))
    asks = left.select("country", F.col("entity_id").alias("s1_id"), F.explode(F.array_distinct(T.salient_tokens(F.col("name_clean"), left_first))).alias("token"))
    return asks.join(few, ["country", "token"]).select("s1_id", "cand_id", F.lit("token").alias("channel")).distinct()


def known_links(links: DataFrame, pool: DataFrame) -> DataFrame:
    """True links whose target is in the pool, as a channel of their own."""
    return links.join(pool.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_semi").select("s1_id", "cand_id", F.lit("known").alias("channel"))


def union_channels(*channels: DataFrame) -> DataFrame:
    """Each pair once."""
    pairs = channels[0].select("s1_id", "cand_id")
    for c in channels[1:]:
        pairs = pairs.unionByName(c.select("s1_id", "cand_id"))
    return pairs.distinct()


def recall(pairs: DataFrame, links: DataFrame, pool: DataFrame) -> DataFrame:
    """n_links, n_found, recall over links whose target is in the pool; 1 if there are none."""
    wanted = known_links(links, pool).select("s1_id", "cand_id").distinct()
    hit = wanted.join(pairs.select("s1_id", "cand_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "cand_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_links"), F.count("hit").alias("n_found")).withColumn("recall", F.when(F.col("n_links") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_links")))


def fanout(pairs: DataFrame) -> DataFrame:
    """n_pairs, n_s1, pairs_per_s1."""
    each = pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("n_s1"), F.avg("n").alias("pairs_per_s1"))


def reduction_ratio(pairs: DataFrame, left: DataFrame, pool: DataFrame) -> DataFrame:
    n = left.agg(F.count(F.lit(1)).alias("n1")).join(pool.agg(F.count(F.lit(1)).alias("n2"))).join(pairs.agg(F.count(F.lit(1)).alias("n_pairs")))
    return n.withColumn("reduction_ratio", 1 - F.col("n_pairs") / (F.col("n1") * F.col("n2")))


def bucket_sizes(pool: DataFrame, keys: list[str]) -> DataFrame:
    """size, n_buckets: how many buckets have how many rows."""
    return pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_buckets"))


def cotenancy(records: DataFrame, by: list[str], discount: bool = True) -> DataFrame:
    """records with the number of those that share the columns, and 1 / (1 + ln n) as a weight."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    out = records.withColumn("n_sharing", n)
    return out.withColumn("weight", 1 / (1 + F.log("n_sharing"))) if discount else out


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")
