"""The 28 features of a pair of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..plans.shared import written

# The features' names in the order of the vector.
NAMES = (
    "name_levenshtein",
    "name_jaro_winkler",
    "name_3gram_jaccard",
    "name_token_jaccard",
    "name_token_sort_ratio",
    "name_len_diff",
    "name_len_ratio",
    "name_prefix_match",
    "name_first_token_match",
    "addr_levenshtein",
    "addr_jaro_winkler",
    "addr_3gram_jaccard",
    "addr_token_jaccard",
    "addr_token_sort_ratio",
    "addr_len_diff",
    "addr_len_ratio",
    "postal_exact_match",
    "postal_both_missing",
    "country_exact_match",
    "digit_count_diff",
    "digit_overlap_count",
    "source_is_s2",
    "source_is_s3",
    "name_word_count_diff",
    "addr_word_count_diff",
    "both_have_address",
    "name_exact_match",
    "composite_similarity",
)
NEEDS_PYTHON = ("name_jaro_winkler", "addr_jaro_winkler", "composite_similarity")


def _digits(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x.rlike(r"\p{Nd}")))


#: What the features need of a record besides its texts, with the texts' columns as prefixes.
FORMS = {
    "words": lambda c: F.array_distinct(T.tokens(c)),
    "sorted": T.sorted_tokens,
    "grams": T.char_trigram_codes,
    "first": lambda c: F.get(T.tokens(c), F.lit(0)),
}
TEXTS = ("name_clean", "addr_clean")
PLAIN = (*TEXTS, "postal", "country")
DERIVED = (*(f"{c}_{form}" for c in TEXTS for form in FORMS), "addr_clean_digits")


def with_forms(records: DataFrame) -> DataFrame:
    """records with the sorted words, 3-grams and digits of their texts: made once for each record, not for each pair."""
    forms = {f"{c}_{form}": make(F.col(c)) for c in TEXTS for form, make in FORMS.items()}
    return records.withColumns(forms | {"addr_clean_digits": _digits(F.col("addr_clean"))})


def expressions(native_only: bool = False) -> dict[str, Column]:
    """The features over the columns of with_forms(), each as a_<column> and b_<column>, and shared()."""
    n1, n2, a1, a2 = F.col("a_name_clean"), F.col("b_name_clean"), F.col("a_addr_clean"), F.col("b_addr_clean")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    both = (F.char_length(a1) > 0) & (F.char_length(a2) > 0)
    given = lambda c, other: F.when(both, c).otherwise(F.lit(other))
    gap = lambda a, b: F.abs(F.char_length(a) - F.char_length(b)).cast("double")
    size = lambda c: (F.size(f"a_{c}"), F.size(f"b_{c}"))
    apart = lambda c: F.abs(size(c)[0] - size(c)[1]).cast("double")
    same = lambda c: F.col(f"__shared_{c}")
    p1, p2 = F.nullif(F.col("a_postal"), F.lit("")), F.nullif(F.col("b_postal"), F.lit(""))

    def jaccard(c: str) -> Column:
        x, y = size(c)
        return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(same(c) / (x + y - same(c)))

    def grams(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        short = (F.char_length(a) < 3) | (F.char_length(b) < 3)
        return F.when(short, (a == b).cast("double")).otherwise(jaccard(f"{c}_grams"))

    out = {
        "name_levenshtein": S.levenshtein_ratio(n1, n2),
        "name_3gram_jaccard": grams("name_clean"),
        "name_token_jaccard": jaccard("name_clean_words"),
        "name_token_sort_ratio": S.levenshtein_ratio(F.col("a_name_clean_sorted"), F.col("b_name_clean_sorted")),
        "name_len_diff": gap(n1, n2),
        "name_len_ratio": S.length_ratio(n1, n2),
        "name_prefix_match": flag((F.substring(n1, 1, 4) == F.substring(n2, 1, 4)) & (F.char_length(n1) >= 4)),
        "name_first_token_match": flag((n1 != "") & (n2 != "") & (F.col("a_name_clean_first") == F.col("b_name_clean_first"))),
        "addr_levenshtein": given(S.levenshtein_ratio(a1, a2), 0.5),
        "addr_3gram_jaccard": given(grams("addr_clean"), 0.0),
        "addr_token_jaccard": given(jaccard("addr_clean_words"), 0.0),
        "addr_token_sort_ratio": given(S.levenshtein_ratio(F.col("a_addr_clean_sorted"), F.col("b_addr_clean_sorted")), 0.5),
        "addr_len_diff": given(gap(a1, a2), 50.0),
        "addr_len_ratio": given(S.length_ratio(a1, a2), 0.0),
        "postal_exact_match": flag(p1 == p2),
        "postal_both_missing": flag(p1.isNull() & p2.isNull()),
        "country_exact_match": flag(F.col("a_country") == F.col("b_country")),
        "digit_count_diff": apart("addr_clean_digits"),
        "digit_overlap_count": same("addr_clean_digits").cast("double"),
        "source_is_s2": flag(F.col("cand_id").startswith("S2-")),
        "source_is_s3": flag(F.col("cand_id").startswith("S3-")),
        "name_word_count_diff": apart("name_clean_words"),
        "addr_word_count_diff": given(apart("addr_clean_words"), 5.0),
        "both_have_address": flag(both),
        "name_exact_match": flag(n1 == n2),
    }
    if not native_only:
        jn, ja = F.col("__jw_name"), F.col("__jw_addr")
        out |= {"name_jaro_winkler": jn, "addr_jaro_winkler": given(ja, 0.5), "composite_similarity": 0.6 * jn + 0.4 * F.when(both, ja).otherwise(jn)}
    return {n: out[n] for n in NAMES if n in out}


def shared(rows: DataFrame) -> DataFrame:
    """rows with the sizes of what both records' arrays have in common, which several features use."""
    arrays = [c for c in DERIVED if c.endswith(("_words", "_grams", "_digits"))]
    return rows.withColumns({f"__shared_{c}": F.size(F.array_intersect(f"a_{c}", f"b_{c}")) for c in arrays})


def hydrated(pairs: DataFrame, records: DataFrame, columns: tuple = PLAIN) -> DataFrame:
    """pairs with both records' columns; pairs with an unknown side are dropped."""
    side = lambda key, p: records.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    return pairs.join(side("s1_id", "a"), "s1_id").join(side("cand_id", "b"), "cand_id")


def pair_features(pairs: DataFrame, records: DataFrame, native_only: bool = False, keep: tuple = (), kind: str = "float", carried: tuple = (), made: dict[str, Column] | None = None) -> DataFrame:
    """s1_id, cand_id, keep, what is made and the features as columns of a kind.

    Jaro-Winkler runs in Python, once for each text pair; native_only leaves
    out the three features that need it.  made: further columns over those of
    both records, and over ``carried`` ones, as a_<column> and b_<column>, so
    that pairs meet their records once for all.
    """
    made = made or {}
    # pairs are few bytes and much work: as many tasks as shuffles have, not as few as their size suggests
    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s1_id")
    rows = shared(hydrated(dealt, written(with_forms(records), "forms"), PLAIN + DERIVED + carried).withColumns(made))
    if not native_only:
        rows = rows.withColumn("__jw_name", S.jaro_winkler(F.col("a_name_clean"), F.col("b_name_clean"))).withColumn("__jw_addr", S.jaro_winkler(F.col("a_addr_clean"), F.col("b_addr_clean")))
    return rows.select("s1_id", "cand_id", *keep, *made, *(e.cast(kind).alias(n) for n, e in expressions(native_only).items()))


def labelled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs with label 1 if they are true links, else 0."""
    true = links.select("s1_id", "cand_id", F.lit(1).alias("label")).distinct()
    return pairs.join(true, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def background(pool: DataFrame, needed: DataFrame, most: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """The needed records and, up to ``most`` in all, others by the order of a seeded hash, or another."""
    must = pool.join(needed.select("entity_id").distinct(), "entity_id", "left_semi")
    room = max(most - must.count(), 0)
    rest = pool.join(needed.select("entity_id").distinct(), "entity_id", "left_anti").orderBy(order if order is not None else F.xxhash64(F.lit(seed), "entity_id"), "entity_id").limit(room)
    return must.unionByName(rest)
