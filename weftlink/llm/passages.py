"""Word-level substring dedup with fixed-block anchors.

Every document's words are cut into non-overlapping blocks of half a window;
the blocks' fingerprints are the index.  Every rolling window of a block's
length in every document probes it.  A repeated window of full length holds a
whole block of each of its occurrences, so the hits, extended by half a window
on either side, contain all maximal exact repeats.

Which of several occurrences is the first can differ from window to window of
one repeat, and a hit can have any number of partners.  So a hit isn't extended
against one partner after the other: the full windows around it are compared
with all others at once by 100-bit fingerprints or more (40 bits of a hash
besides the bucket it chose, and 64 of a second), and all but the first
occurrence are removed.  The runs of windows that go are the maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import forget, materialise

HIT, GONE = 1, 2


def _windows(raw: np.ndarray, at: np.ndarray, n: int, two: bool) -> tuple:
    """Fingerprints of all windows of n words that lie in one text: hashes, text number, first word."""
    start, end, edge = K.words(raw, at)
    count = np.maximum(np.diff(edge) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = edge[doc] + place
    out = []
    for which in (0, 1) if two else (0,):
        h = K.word_hashes(raw, start, end, which)
        out.append(K.spans(K.prefix_sums(h, which), first, first + n, which))
    return out, doc, place, edge


def nominate(texts: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """Index blocks, probe them with all rolling windows: the hits' first words as k1."""
    block = window // 2

    def send(raw, at, _):
        (key,), doc, place, _ = _windows(raw, at, block, False)
        order, new = X.groups(key)
        size = np.diff(np.append(new, len(order)))
        again = np.repeat(size > 1, size)
        rep = order[new]
        anchor = place % block == 0
        flag = (np.logical_or.reduceat(anchor[order], new) if len(new) else np.zeros(0, bool)) | (size > 1)
        known = order[again]  # repeated in this batch: nominated whatever others hold
        entries = X.Entries(key[rep], [(flag | ((size > 1) << 1)).astype(np.uint8)], doc[rep], place[rep])
        return entries, (doc[known], np.full(len(known), HIT, np.int8), place[known, None])

    def decide(e, _):
        order, new = X.groups(e.key)
        size = np.diff(np.append(new, len(order)))
        flag = e.extra[0][order]
        hit = np.repeat((size > 1) & (np.bitwise_or.reduceat(flag, new) > 0), size) & (flag < 2)
        found = order[hit]
        return e.doc[found], np.full(len(found), HIT, np.int8), e.at[found, None]

    return X.run(texts, [], n_buckets, send, decide, ("u1",), (HIT,))


def first_only(texts: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """texts with hits in k1: the first words of windows that also start earlier, as k2."""
    block = window // 2

    def send(raw, at, batch):
        (one, two), doc, place, edge = _windows(raw, at, window, True)
        hits = batch.column("k1")
        owner = np.repeat(np.arange(len(hits)), np.asarray(pa.compute.list_value_length(hits).fill_null(0)))
        hit = np.asarray(hits.flatten(), np.int64)
        words = int(edge[-1])
        near = X.covered(words, np.maximum(edge[owner] + hit - (window - block), edge[owner]), edge[owner] + hit + 1)
        take = np.flatnonzero(near[edge[doc] + place])
        one, two, doc, place = one[take], two[take], doc[take], place[take]
        did, uid = np.asarray(batch.column("did"))[doc], np.asarray(batch.column("uid"))[doc]
        by = np.lexsort((place, uid, did))  # so that the first of equal windows is the earliest
        order, new = X.groups(one[by], two[by])
        order = by[order]
        later = np.ones(len(order), bool)
        later[new] = False
        gone, rep = order[later], order[new]
        same = np.zeros(len(gone), bool)
        if len(gone):  # repeated rows are one document
            head = np.repeat(rep, np.diff(np.append(new, len(order))))[later]
            same = (did[gone] == did[head]) & (uid[gone] == uid[head]) & (place[gone] == place[head])
        gone = gone[~same]
        return X.Entries(one[rep], [two[rep]], doc[rep], place[rep]), (doc[gone], np.full(len(gone), GONE, np.int8), place[gone, None])

    def decide(e, docs):
        did, uid = docs.did[e.doc], docs.uid[e.doc]
        by = np.lexsort((e.at, uid, did))
        order, new = X.groups(e.key[by], e.extra[0][by])
        order = by[order]
        later = np.ones(len(order), bool)
        later[new] = False
        gone = order[later]
        head = np.repeat(order[new], np.diff(np.append(new, len(order))))[later]
        gone = gone[~((did[gone] == did[head]) & (uid[gone] == uid[head]) & (e.at[gone] == e.at[head]))]
        return e.doc[gone], np.full(len(gone), GONE, np.int8), e.at[gone, None]

    return X.run(texts, ["k1"], n_buckets, send, decide, ("<u8",), (GONE,))


def repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, uid, k2: the first words of each document's windows that also start earlier."""
    texts, n = X.keyed(docs, id_col, text_col), X.buckets_for(docs)
    hits = materialise(nominate(texts, n, window), "hits")
    near = texts.join(hits.hint("shuffle_hash"), ["did", "uid"])
    gone = materialise(first_only(near, n, window), "repeats")
    forget(hits)
    return gone


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, text: the kept words joined by spaces.

    Words lie between ASCII white space.  A word goes if a window of ``window``
    words that holds it has the same words as one that starts earlier: in a
    document with a smaller id, or earlier in its own.  Windows are judged on
    the input and don't cross documents.  A null text has no words, and null ids
    come last.  Rows with the same id and text are one document; rows with the
    same id and other texts are ordered by a hash.  Other columns are ignored.
    """
    gone = repeats(docs, window, id_col, text_col)
    rows = X.keyed(docs, id_col, text_col).withColumn("doc_id", F.when(F.col("did") != X.LAST, F.col("did")))
    joined = rows.join(gone.hint("shuffle_hash"), ["did", "uid"], "left").select("doc_id", "text", "k2")

    def cut(batches):
        for b in K.slices(batches):
            raw, at = K.text_bytes(b.column("text"))
            start, end, edge = K.words(raw, at)
            lists = b.column("k2")
            owner = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
            first = edge[owner] + np.asarray(lists.flatten(), np.int64)
            dead = X.covered(int(edge[-1]), first, first + window)
            digests, kept = [], []
            data = raw.tobytes()
            for i in range(b.num_rows):
                alive = np.flatnonzero(~dead[edge[i] : edge[i + 1]]) + edge[i]
                s = b" ".join(data[x:y] for x, y in zip(start[alive].tolist(), end[alive].tolist(), strict=True))
                digests.append(hashlib.sha256(s).hexdigest())
                if with_text:
                    kept.append(s.decode("utf-8", "replace"))
            removed = np.add.reduceat(np.append(dead, 0), np.minimum(edge[:-1], len(dead))) * (np.diff(edge) > 0)
            columns = [b.column("doc_id"), pa.array(np.diff(edge).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])

    return joined.mapInArrow(K.tidied(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
