"""Language identification with averaged hashed subword embeddings.

Subwords are the byte 1- to 4-grams of the lower-cased text, hashed to
embeddings.  A text is their mean, a linear softmax gives the languages, and
stochastic gradient descent trains both in numpy.  A temperature, fitted on
documents apart from the training ones, calibrates the score; a document whose
score is too low for the wanted precision is marked as not accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

ORDERS = (1, 2, 3, 4)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    languages: tuple
    table: np.ndarray  # language x bucket: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    accept: float
    bits: int


def subwords(raw: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the subword that starts at each byte; the last ones of a text reach over its end."""
    low = _LOWER[raw]
    h = np.full(len(raw), order * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h[: len(raw) - k] += low[k:] * _FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def bags(texts: DataFrame, bits: int, *carry: str) -> DataFrame:
    """carry, idx, weight: each text's buckets and their share of its subwords, as packed int32 and float32."""

    def count(batches):
        for b in K.slices(batches):
            raw, at = K.text_bytes(b.column("text"))
            rows, keys = [], []
            for n in ORDERS:
                h = subwords(raw, n, bits)
                row = np.repeat(np.arange(b.num_rows), np.diff(at))
                whole = np.arange(len(raw)) + n <= at[row + 1]
                rows.append(row[whole])
                keys.append(h[whole])
            row, key, n = K.distinct_by_row(np.concatenate(rows), np.concatenate(keys), bits)
            total = np.bincount(row, n, b.num_rows)
            sizes = np.bincount(row, minlength=b.num_rows)
            ends = np.cumsum(sizes)[:-1]
            packed = [pa.array([x.tobytes() for x in np.split(v, ends)], pa.binary()) for v in (key.astype("<i4"), (n / total[row]).astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *packed], [*carry, "idx", "weight"])

    schema = ", ".join(f"{c} {dict(texts.dtypes)[c]}" for c in carry)
    return texts.select(*carry, "text").mapInArrow(K.tidied(count), f"{schema}, idx binary, weight binary")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list, bits: int, dim: int = 8, epochs: int = 12, rate: float = 2.0, precision: float = 0.995, seed: int = 5) -> Model:
    """rows: (language, idx, weight).  Every fifth row is kept for calibration."""
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return Model((), np.zeros((0, 1 << bits)), np.zeros(0), 1.0, 1.0, bits)
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embed, soft, bias = *(rng.normal(0, 0.1, shape).astype(np.float32) for shape in ((1 << bits, dim), (dim, len(languages)))), np.zeros(len(languages), np.float32)
    data = [(number[a], i, w) for a, i, w in rows]
    fit = [x for k, x in enumerate(data) if k % 5 or len(data) < 10]
    apart = [x for k, x in enumerate(data) if k % 5 == 0] or fit
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            y, idx, w = fit[k]
            mean = w @ embed[idx]
            g = softmax(mean @ soft + bias)
            g[y] -= 1
            step = rate * (1 - done / steps)
            back = soft @ g
            soft -= step * np.outer(mean, g)
            bias -= 0.1 * step * g
            embed[idx] -= np.float32(step * 10) * w[:, None] * back
            done += 1
    table, bias = (embed @ soft).T.astype(float), bias.astype(float)
    z = np.array([table[:, i] @ w + bias for _, i, w in apart])
    y = np.array([a for a, _, _ in apart])
    choices = np.geomspace(0.2, 20, 80)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in choices]
    t = float(choices[int(np.argmin(loss))])
    p = softmax(z / t)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return Model(languages, table, bias, t, float(p.max(1)[order[good[-1]]]) if len(good) else 1.0, bits)


def scores(model: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Calibrated probabilities, row by language; rows without subwords get the prior."""
    z, total = np.zeros((len(at) - 1, len(model.languages))), np.zeros(len(at) - 1)
    for n in ORDERS:
        h = subwords(raw, n, model.bits)
        last = np.maximum(at[1:] - n + 1, at[:-1])
        total += last - at[:-1]
        for k in range(len(model.languages)):
            z[:, k] += K.row_sums(model.table[k][h], at[:-1], last)
    return softmax((z / np.maximum(total, 1)[:, None] + model.bias) / model.temperature)


def sample(rows: DataFrame, key: Column, most: int, once: bool = False) -> DataFrame:
    """At most ``most`` rows, the same ones in every run: those whose key hashes lowest.

    Of rows with one key, those come first whose other columns hash lowest.
    once: repeated rows count once.
    """
    n = rows.select(key.alias("k")).count()
    share = min(1.0, 1.2 * (most + 50) / max(n, 1))
    h = F.xxhash64(key)
    near = rows.where(F.pmod(h, F.lit(1 << 24)) < F.lit(int(share * (1 << 24)) + 1))
    return (near.distinct() if once else near).orderBy(h, F.xxhash64(*rows.columns)).limit(most)


def with_texts(docs: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """few (a bounded sample with the keys) with the texts of docs, each different row once.

    The sample is sent to the documents, so that only the texts wanted move.
    """
    return docs.join(F.broadcast(few.distinct()), keys).dropDuplicates([*few.columns, "text_hash"])


def learn(docs: DataFrame, usable: Column, most: int = 3000, bits: int = 15) -> Model:
    """Train on at most ``most`` labelled rows of docs (doc_id, text, lang) that are usable.

    Rows are chosen by their keys before any text moves, and a repeated row
    counts once.  The bound also bounds what comes to the driver: a row is at
    most 2**bits pairs, however long its text is.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), "text")
    keys = ["doc_id", "lang", "text_hash"]
    few = sample(rows.select(*keys), F.col("doc_id"), most, once=True)
    found = bags(with_texts(rows, few, keys), bits, *keys).orderBy(*keys).toLocalIterator()
    return train([(r["lang"], np.frombuffer(r["idx"], "<i4"), np.frombuffer(r["weight"], "<f4")) for r in found if r["idx"]], bits)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row of docs (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0, as is every
    text when there was nothing to learn from.  Texts are read whole.  Repeated
    rows stay repeated; other columns are ignored.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.when(letters, F.col("text")).alias("text"))

    def predict(batches):
        m = shared.value
        for b in K.slices(batches):
            raw, at = K.text_bytes(b.column("text"))
            known = ~np.asarray(b.column("text").is_null())
            if not m.languages:
                known[:] = False
            p = scores(m, raw, at) if m.languages else np.zeros((b.num_rows, 1))
            best = p.argmax(1)
            score = np.where(known, p.max(1), 0.0)
            names = pa.array([m.languages[i] if k else "und" for i, k in zip(best, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names, pa.array(score), pa.array(known & (score >= m.accept))], ["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(K.tidied(predict), "doc_id long, lang_pred string, score double, accepted boolean")
