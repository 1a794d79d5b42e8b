"""Quality rules on documents and on their hosts, in native expressions.

Each document is judged by rules of its own.  Their failures are summed by
host; a host's failure rate is shrunk towards the mean of all hosts with a beta
prior whose strength is estimated from the hosts themselves.  A host whose
shrunk rate is too high is rejected with all its documents.

The text is read once: counts go to a written table, and hosts are aggregated
from it with partial sums, so that a host with a third of all documents costs
one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAKS, bind, fresh, looked_up, materialise, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words lie in n-word windows that occur twice or more in the text."""
    grams = bind(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))))

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        starts = F.sort_array(F.transform(bind(ranked, again), lambda e: e["i"]))
        start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(starts, start, lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(n), p - acc["last"])).alias("sum")), lambda acc: acc["sum"])

    return bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))).cast("long")


def rules(text: Column) -> Column:
    """The counts of one text as a struct; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    lines = bind(F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(BREAKS)) != ""), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    counted = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", w)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    )
    return bind(words_of(text), counted)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: doc_id, host, and the fields of rules()."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), rules(F.col(text_col)).alias("rules"))
    return rows.select("doc_id", "host", "rules.*")


def failing(min_words: int, max_repeat_pct: int) -> Column:
    """The base verdict over the columns of rule_counts()."""
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_pct) * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(mean, strength) of the hosts' failure rates by the method of moments.

    hosts: n, failed.  One row comes to the driver, however many hosts there are.
    """
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    s = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("k"), F.sum(f * f / n).alias("ff")).first()
    if not s["n"] or s["k"] < 2:
        return (s["f"] or 0.0) / (s["n"] or 1.0), 1.0
    mean = s["f"] / s["n"]
    spread = (s["ff"] - mean * mean * s["n"]) / s["n"]  # weighted variance of the rates between hosts
    within = mean * (1 - mean) * s["k"] / s["n"]  # what sampling alone would give
    between = max(spread - within, 1e-6)
    return mean, min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, host_rate from host, base_failed; rows without a host are left out."""
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    mean, strength = beta_prior(hosts)
    return hosts.select("host", ((F.col("failed") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))


#: Up to so many hosts are sent to all tasks; of more only those with many documents are.
FEW_HOSTS = 100_000


def with_hosts(rows: DataFrame, hosts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of hosts (one row a host), null where there are none.

    Few hosts are sent to all tasks, so documents stay where they are.  Of more
    the hot ones are, and other documents are shuffled by host: the rows are the
    same either way, and no task holds all documents of a hot host or all those
    without one.
    """
    if hosts.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        return rows.join(F.broadcast(hosts), key, "left")
    named = looked_up(rows.where(F.col(key).isNotNull()), hosts, key)
    return named.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_pct: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """Judge documents by their own rules, then by their host.

    Returns the columns of rule_counts() with base_failed, host_rate (the
    host's shrunk failure rate) and kept.  Null texts are empty and fail;
    documents without a host get no host verdict.  Each input row gives one
    output row, so repeated rows stay repeated; an empty table gives none.
    Columns besides id, text and host are ignored.
    """
    counts = materialise(rule_counts(docs, id_col, text_col, host_col), "rules")
    judged = counts.withColumn("base_failed", failing(min_words, max_repeat_pct))
    verdict = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate)
    return with_hosts(judged, host_rates(judged), "host").withColumn("kept", verdict)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_pct: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that host_rules() would keep.

    The base verdict is written beside each row, so no row has to be found
    again by its id: repeated and null ids are kept apart.  A null or empty
    text fails; a row without a host is judged by its text alone.  Columns may
    have any names.  An empty table gives an empty one.
    """
    counts, key, failed, refused = fresh(docs, "counts", "host_key", "failed", "refused")
    judged = materialise(
        docs.withColumn(counts, rules(F.col(text_col))).select("*", F.col(host_col).alias(key)).withColumn(failed, (F.col(f"{counts}.n_words") < min_words) | (F.lit(100) * F.col(f"{counts}.n_repeat_words") > F.lit(max_repeat_pct) * F.col(f"{counts}.n_words"))),
        "judged",
    )
    rates = host_rates(judged.select(F.col(key).alias("host"), F.col(failed).alias("base_failed")))
    bad = rates.where(F.col("host_rate") > max_host_rate).select(F.col("host").alias(key), F.lit(True).alias(refused))
    good = with_hosts(judged.where(~F.col(failed)), bad, key).where(F.col(refused).isNull())
    return good.select(*(F.col(f"`{c}`") for c in docs.columns))
