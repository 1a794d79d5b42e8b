"""Soft-membership mixing of documents to target domain weights, natively.

A naive Bayes classifier learned from a labelled table gives each document a
posterior over domains.  Each document then gets a rate r >= 0 such that the
expected tokens of each domain, sum over documents of r * tokens * posterior,
come as near as possible to the targets: least squares on relative residuals,
solved by projected gradient descent.  An iteration is one distributed sum of
as many numbers as there are domains; the documents' rates follow from those
sums alone, so they are an expression and are never stored between iterations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, fresh, looked_up, materialise
from .language import sample

#: Every ASCII character but letters; letters of other scripts are letters here.
_NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
ALWAYS = "#"
_SIGNS = "[#*$%&|<>!]"


@dataclass(frozen=True)
class Fit:
    """weights: feature, w_<domain>; base: the score of a document without features."""

    domains: tuple
    weights: DataFrame
    base: tuple


def evidence(text: Column) -> Column:
    """struct(n_tokens, features): letter runs in lower case, each once, and marks of shape.

    The marks begin with ``#`` so that no letter run equals one: how often
    tokens repeat in fifths, the share of signs, and one that all texts have.
    """
    text = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(F.lower(text), _NO_LETTERS), lambda w: w != "")
    signs = F.char_length(text) - F.char_length(F.regexp_replace(text, _SIGNS, ""))
    share = F.least(F.lit(9), F.floor(F.lit(50) * signs / F.greatest(F.char_length(text), F.lit(1))))

    def marked(t: Column) -> Column:
        return bind(F.array_distinct(t), lambda d: F.struct(F.size(t).cast("long").alias("n_tokens"), F.concat(d, F.array(F.lit(ALWAYS), F.concat(F.lit("#signs"), share.cast("string")), F.concat(F.lit("#repeat"), F.floor(F.lit(5) * F.size(d) / F.greatest(F.size(t), F.lit(1))).cast("string")))).alias("features")))

    return bind(tokens, marked)


def learn(docs: DataFrame, labels: DataFrame, domains: tuple, most: int = 4000, n_features: int = 500, least: int = 5, clear: float = 0.3) -> Fit:
    """Fit on at most ``most`` rows of labels (doc_id, domain).

    The ``n_features`` features (a bounded table) that tell most about the
    domain are kept, of those in ``least`` documents or more that tell
    ``clear`` nats or more each time: many weak ones together would mislead, as
    they hang on each other.  Rows with a null id or another domain are left
    out; without any, all domains are as likely.
    """
    few = sample(labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).select("doc_id", "domain"), F.col("doc_id"), most)
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("domain", evidence(F.col("text"))["features"].alias("f"))
    of = lambda d: F.sum((F.col("domain") == d).cast("double"))
    counts = known.select("domain", F.explode("f").alias("feature")).groupBy("feature").agg(*(of(d).alias(f"n{i}") for i, d in enumerate(domains)))
    counts = materialise(counts, "evidence")
    total = counts.where(F.col("feature") == ALWAYS).first()
    n = [float(total[f"n{i}"] if total else 0.0) for i in range(len(domains))]
    seen = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0.0))
    told = sum((F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * F.log(F.col(f"n{i}") * (sum(n) or 1.0) / (seen * max(n[i], 1.0)))).otherwise(0.0) for i in range(len(domains))), F.lit(0.0))
    best = counts.where((F.col("feature") != ALWAYS) & (seen >= least)).withColumn("told", told).where(F.col("told") >= clear * seen).orderBy(F.desc("told"), "feature").limit(n_features)
    p = [(F.col(f"n{i}") + 0.5) / F.lit(n[i] + 1.0) for i in range(len(domains))]
    best = materialise(best.select("feature", *(x.alias(f"p{i}") for i, x in enumerate(p))), "weights")
    absent = best.agg(*(F.sum(F.log1p(-F.col(f"p{i}"))).alias(f"a{i}") for i in range(len(domains)))).first()
    base = tuple(math.log((n[i] + 1) / (sum(n) + len(n))) + (absent[i] or 0.0) for i in range(len(domains)))
    weights = best.select("feature", *((F.log(F.col(f"p{i}")) - F.log1p(-F.col(f"p{i}"))).alias(f"w{i}") for i in range(len(domains))))
    always = counts.sparkSession.createDataFrame([(ALWAYS, *[0.0] * len(domains))], weights.schema)
    return Fit(domains, weights.unionByName(always), base)


def posteriors(docs: DataFrame, fit: Fit) -> DataFrame:
    """doc_id, text_hash, n_tokens, n_rows, p: one row for each different (doc_id, text).

    n_rows: how many input rows it stands for.  p: the domains' probabilities.
    """
    k = range(len(fit.domains))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), evidence(F.col("text")).alias("e"))
    rows = rows.select("doc_id", "text_hash", F.col("e.n_tokens").alias("n_tokens"), F.explode("e.features").alias("feature"))
    scored = rows.join(F.broadcast(fit.weights), "feature").groupBy("doc_id", "text_hash").agg(F.max("n_tokens").alias("n_tokens"), F.sum((F.col("feature") == ALWAYS).cast("long")).alias("n_rows"), *(F.sum(f"w{i}").alias(f"s{i}") for i in k))
    z = F.array(*(F.col(f"s{i}") / F.col("n_rows") + F.lit(fit.base[i]) for i in k))
    e = bind(z, lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))
    p = bind(e, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
    return scored.select("doc_id", "text_hash", "n_tokens", "n_rows", p.alias("p"))


def fit_rates(soft: DataFrame, targets: list[float], total: float | None = None, anchor: int | None = None, iterations: int = 60, close: float = 1e-5, written: int = 8) -> tuple[DataFrame, Column]:
    """The rows of posteriors() and the rate of each as an expression over them.

    targets: the domains' weights.  total: tokens to reach, by default those
    there are.  anchor: instead, the total at which this domain keeps 1.1 times
    its tokens.  After ``written`` iterations the rates so far are written
    beside the rows, so that the expression stays short.
    """
    k = range(len(targets))
    weight = np.array(targets, float) / sum(targets)
    tokens = F.col("n_tokens").cast("double") * F.col("n_rows")

    def sums(rate: Column) -> np.ndarray:
        row = soft.agg(*(F.sum(tokens * rate * F.col("p")[i]).alias(f"t{i}") for i in k)).first()
        return np.array([x or 0.0 for x in row])

    rate = F.lit(1.0)
    have = sums(rate)
    total = float(have.sum()) if total is None else total
    if anchor is not None and weight[anchor] > 0:
        total = 1.1 * have[anchor] / weight[anchor]
    goal = weight * total
    scale = np.maximum(have, 1e-3 * max(have.sum(), 1.0))  # residuals count relative to the tokens there are
    # of residual / scale the second derivative in token-weighted rates has at most this eigenvalue
    gram = soft.agg(*(F.sum(tokens * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in k for j in k)).first()
    h = np.array([x or 0.0 for x in gram]).reshape(len(k), len(k)) / np.sqrt(np.outer(scale, scale))
    step = 1.0 / max(float(np.linalg.eigvalsh((h + h.T) / 2)[-1]), 1e-12)
    for turn in range(1, iterations + 1):
        miss = (have - goal) / scale
        if np.abs(have - goal).max() <= close * max(total, 1.0):
            break
        push = sum((F.lit(float(step * m)) * F.col("p")[i] for i, m in enumerate(miss)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - push)
        if turn % written == 0:
            soft, rate = materialise(soft.withColumn("rate_so_far", rate), "rates"), F.col("rate_so_far")
        now = sums(rate)
        if np.abs(now - have).max() <= close * max(total, 1.0):
            have = now
            break
        have = now
    return soft, rate


def mix(docs: DataFrame, labels: DataFrame, targets: dict, **limits) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate for every row of docs (doc_id, text).

    labels: doc_id, domain.  targets: domain -> weight.  A null text has no
    tokens.  Repeated rows stay repeated; other columns are ignored.
    """
    soft, rate = solve(docs, labels, targets, **limits)
    return soft.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(targets)), rate.alias("rate"), F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("copy_number")).drop("copy_number")


def solve(docs: DataFrame, labels: DataFrame, targets: dict, anchor: str | None = None, **limits) -> tuple[DataFrame, Column]:
    domains = tuple(targets)
    soft = materialise(posteriors(docs, learn(docs, labels, domains, **limits)), "posteriors")
    return fit_rates(soft, list(targets.values()), anchor=None if anchor is None else domains.index(anchor))


def draw(docs: DataFrame, labels: DataFrame, targets: dict, **limits) -> DataFrame:
    """docs with each row as often as its rate says.

    A rate of 2.3 gives two copies and, for three in ten documents by the hash
    of their id and text, a third.  All columns are kept, whatever their names.
    A null text is one without tokens, and null ids are one id.  Rows with the
    same id and text have the same rate.  An empty table gives an empty one.
    """
    soft, rate = solve(docs, labels, targets, **limits)
    part = F.pmod(F.xxhash64(F.lit(9), "doc_id", "text_hash"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    key, copies, nth = fresh(docs, "key", "copies", "nth")
    # one key of id and text; a null id is told from all others by its flag
    both = lambda text_hash: F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), text_hash.alias("hash"))
    soft = soft.select(both(F.col("text_hash")).alias(key), F.floor(rate + part).cast("int").alias(copies))
    rows = looked_up(docs.withColumn(key, both(F.xxhash64("text"))), soft, key).where(F.col(copies) > 0)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), copies)).alias(nth)).drop(nth)
