"""Quality classification by ordinal regression on graded ratings.

A cumulative-link model shares one weight vector over hashed text features
between all grades and separates the grades by ordered thresholds:
P(grade >= k) = sigmoid(w.x - threshold_k).  It gives the expected grade and
the tail probability by which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .language import sample, with_texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = ~_LETTER & ~K.IS_BREAK
_SIGN[48:58] = False


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int


def features(raw: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct features of each text.

    They are its letter runs in lower case, its pairs of signs, and two graded
    ones: how often its words repeat, and how long it is.
    """
    n = len(at) - 1
    mask = U = K.U64((1 << bits) - 1)
    s, e, edge = K.words(raw, at, ~_LETTER)
    h = K.word_hashes(_LOWER[raw], s, e)
    row = np.repeat(np.arange(n), np.diff(edge))
    rows, keys = [row], [h & mask]
    pair = np.flatnonzero(_SIGN[raw[:-1]] & _SIGN[raw[1:]]) if len(raw) > 1 else np.zeros(0, np.int64)
    where = np.searchsorted(at, pair, "right") - 1
    inside = pair + 1 < at[where + 1]
    pair, where = pair[inside], where[inside]
    rows.append(where)
    keys.append(K.mixed(raw[pair].astype(K.U64) * K.U64(257) + raw[pair + 1] + K.U64(1 << 40)) & mask)
    owner, _, _ = K.distinct_by_row(row, h >> K.U64(24), 40)
    total, kinds = np.diff(edge), np.bincount(owner, minlength=n)
    repeat = (10 * (1 - kinds / np.maximum(total, 1))).astype(np.int64)
    size = np.log2(total + 1).astype(np.int64)
    for base, grade in ((1 << 41, repeat), (1 << 42, size)):
        rows.append(np.arange(n))
        keys.append(K.mixed(grade.astype(K.U64) + K.U64(base)) & U)
    return K.distinct_by_row(np.concatenate(rows), np.concatenate(keys), bits)[:2]


def bags(texts: DataFrame, bits: int, *carry: str) -> DataFrame:
    def find(batches):
        for b in K.slices(batches):
            row, key = features(*K.text_bytes(b.column("text")), bits)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), K.list_array(key.astype(np.int32), np.bincount(row, minlength=b.num_rows))], [*carry, "idx"])

    schema = ", ".join(f"{c} {dict(texts.dtypes)[c]}" for c in carry)
    return texts.select(*carry, "text").mapInArrow(K.tidied(find), f"{schema}, idx array<int>")


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def slopes(s: np.ndarray, g: int) -> tuple[float, np.ndarray]:
    """Derivatives of the log-likelihood of grade g by the score and by each threshold; s: P(grade >= k) for k from 1."""
    top = len(s)
    above, below = (s[g - 1] if g else 1.0), (s[g] if g < top else 0.0)
    p = max(above - below, 1e-9)
    da, db = above * (1 - above), below * (1 - below)
    dt = np.zeros(top)
    if g:
        dt[g - 1] -= da / p
    if g < top:
        dt[g] += db / p
    return (da - db) / p, dt


def train(rows: list, bits: int, grades: int, epochs: int = 12, rate: float = 0.1, shrink: float = 1e-5, least: int = 4, seed: int = 3) -> Model:
    """rows: (grade, idx).  Features in fewer than ``least`` rows keep weight 0.

    Adaptive stochastic gradient descent on the log-likelihood of the grade;
    thresholds are kept in order by training their first and the logs of their
    gaps.
    """
    seen = np.bincount(np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64), minlength=1 << bits)
    w, gw = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
    counts = np.bincount([g for g, _ in rows], minlength=grades) + 1.0
    tail = counts[::-1].cumsum()[::-1][1:] / counts.sum()
    t = np.log((1 - tail) / tail)
    gap, ggap = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))]), np.full(grades - 1, 1e-2)
    data = [(g, i[seen[i] >= least]) for g, i in ((g, np.asarray(i)) for g, i in rows)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            g, idx = data[k]
            t = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
            z = w[idx].sum()
            s = sigmoid(z - t)
            dz, dt = slopes(s, g)
            dz, dt = np.clip(dz, -5, 5), np.clip(dt, -5, 5)
            dgap = dt[::-1].cumsum()[::-1] * np.concatenate([[1.0], np.exp(gap[1:])])
            grad = -dz + shrink * w[idx]
            gw[idx] += grad * grad
            w[idx] -= rate * grad / np.sqrt(gw[idx])
            ggap += dgap * dgap
            gap += 0.05 * dgap / np.sqrt(ggap)
    return Model(w, np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])])), bits)


def learn(docs: DataFrame, ratings: DataFrame, grades: int = 3, most: int = 6000, bits: int = 18) -> Model:
    """Train on at most ``most`` rated rows.

    docs: doc_id, text; ratings: doc_id, grade from 0 to grades - 1.  Null
    ratings are left out.  A document with two grades counts once with each,
    and repeated rows count once.  Where several texts share a rated id, the
    rows of lowest hash are taken, ``most`` in all.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).select("doc_id", F.col("grade").cast("int").alias("grade"))
    rated = sample(rated, F.col("doc_id"), most, once=True)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    keys = ["doc_id", "grade", "text_hash"]
    few = sample(texts.select("doc_id", "text_hash").join(F.broadcast(rated), "doc_id").select(*keys), F.col("doc_id"), most, once=True)
    found = bags(with_texts(texts, few, ["doc_id", "text_hash"]), bits, *keys).orderBy(*keys)
    return train([(r["grade"], np.asarray(r["idx"], np.int64)) for r in found.toLocalIterator()], bits, grades)


def grade(docs: DataFrame, model: Model, target: int = 2, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= target)), kept (tail >= least) of every row.

    A null text is an empty one.  Repeated rows stay repeated; other columns
    are ignored.  An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for b in K.slices(batches):
            row, key = features(*K.text_bytes(b.column("text")), m.bits)
            z = np.bincount(row, m.weights[key], b.num_rows)
            p = sigmoid(z[:, None] - m.thresholds[None])
            tail = p[:, target - 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.sum(1)), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidied(score), "doc_id long, expected_grade double, tail double, kept boolean")


def graded(quality: Column, toxic: Column) -> Column:
    """0: toxic; 1: not toxic, of low quality; 2: not toxic, of high quality."""
    return F.when(toxic == 1, F.lit(0)).when(quality.isNotNull(), F.lit(1) + quality.cast("int"))
