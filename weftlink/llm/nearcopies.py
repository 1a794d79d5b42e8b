"""Near-duplicate documents by SuperMinHash.

A document is its set of word shingles.  SuperMinHash gives each shingle
correlated ranks, one for each place of a signature, drawn without repetition;
the smallest rank wins a place.  That has less variance than independent hashes,
and a document is done as soon as no further rank can win anywhere.

Documents with equal sets are one class.  Classes whose signatures agree in a
band meet in a bucket; chains of buckets are clusters, found by distributed
union-find over one edge a member.  Within a cluster all sets are compared in
full, block by block, and the confirmed links give the components, again by
union-find.  A long chain of small buckets can join sets that have little in
common; where that takes fewer comparisons, a cluster's buckets are compared one
by one instead.  Either way all sets that share a band are compared, and no pair
needs a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import forget, fresh, looked_up, materialise
from .components import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EMPTY = np.iinfo(np.uint64).max


def shingles(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of the distinct shingles, ordered by both.

    Words are lower-cased in ASCII.  A text with fewer words than a shingle has
    one shingle, all its words; one without words has none.
    """
    start, end, edge = K.words(raw, at)
    sums = K.prefix_sums(K.word_hashes(_LOWER[raw], start, end))
    n = np.diff(edge)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    first = edge[doc] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n, width)[doc]
    h = K.mixed(K.spans(sums, first, first + size) + size.astype(K.U64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def superminhash(doc: np.ndarray, h: np.ndarray, n_docs: int, places: int) -> np.ndarray:
    """Signatures, one row for each document; rows of documents without shingles are all _EMPTY.

    In step j every shingle draws a rank j + r, 0 <= r < 1, and a place from
    those it hasn't had yet (a Fisher-Yates shuffle).  After step j a document
    whose places all hold ranks below j + 1 is done.
    """
    out = np.full((n_docs, places), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    perm = None
    for j in range(places):
        x = K.mixed(h + K.U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = (x & K.U64(0xFFFFFFFF)) | K.U64(j << 32)
        k = (j + ((x >> K.U64(32)) * K.U64(places - j) >> K.U64(32)).astype(np.int64)).astype(np.int64)
        if perm is None:
            place = k
        else:
            row = np.arange(len(h))
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(flat, doc * places + place, rank)
        open_docs = (out >= K.U64((j + 1) << 32)).any(1)
        go = open_docs[doc]
        if not go.any():
            break
        if perm is None:
            perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (int(go.sum()), 1))
            perm[np.arange(len(perm)), k[go]] = 0
        else:
            perm = perm[go]
        doc, h = doc[go], h[go]
    return out


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """did, uid, n (set size), cid (class of equal sets), bands (a hash of each) for each row."""

    def run(batches):
        for b in K.slices(batches, most=1 << 20):
            n_docs = b.num_rows
            doc, h = shingles(*K.text_bytes(b.column("text")), width)
            n = np.bincount(doc, minlength=n_docs)
            edge = np.searchsorted(doc, np.arange(n_docs + 1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mixed(h), dtype=np.uint64)])
            cid = K.mixed(sums[edge[1:]] - sums[edge[:-1]] + n.astype(np.uint64)).view(np.int64)
            sig = superminhash(doc, h, n_docs, bands * rows).reshape(n_docs, bands, rows)
            band = np.zeros((n_docs, bands), np.uint64)
            for r in range(rows):
                band = K.mixed(band * K.U64(0x9E3779B97F4A7C15) + sig[:, :, r])
            band = K.mixed(band + np.arange(bands, dtype=np.uint64)[None]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("uid"), pa.array(n.astype(np.int64)), pa.array(cid), K.list_array(band.reshape(-1), np.full(n_docs, bands))], ["did", "uid", "n", "cid", "bands"])

    return docs.mapInArrow(K.tidied(run), "did long, uid long, n long, cid long, bands array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """cid, items: the sorted fingerprints of each text's shingles."""

    def run(batches):
        for b in K.slices(batches):
            doc, h = shingles(*K.text_bytes(b.column("text")), width)
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            items = [h[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(items, pa.binary())], ["cid", "items"])

    return docs.select("cid", "text").mapInArrow(K.tidied(run), "cid long, items binary")


def joined_pairs(items: list[np.ndarray], block: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs that link what any chain of pairs with 100 * intersection >= percent * union links.

    across: only pairs from different blocks count.  Few sets are merged pair
    by pair; more are multiplied as a 0/1 matrix, some thousand columns at once.
    """
    k = len(items)
    size = np.array([len(x) for x in items], np.int64)
    parent = list(range(k))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def union(i: int, j: int) -> None:
        x, y = find(i), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))

    if k <= 8:
        for i in range(k):
            for j in range(i):
                if (across and block[i] == block[j]) or 100 * min(size[i], size[j]) < percent * max(size[i], size[j]) or find(i) == find(j):
                    continue
                both = np.concatenate([items[i], items[j]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (size[i] + size[j] - common):
                    union(i, j)
        return out
    owner = np.repeat(np.arange(k), size)
    _, column, n = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, column = owner[shared], (np.cumsum(n > 1) - 1)[column[shared]]
    common = np.zeros((k, k), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [first, first + width])
        part = np.zeros((k, width), np.float32)
        part[owner[x:y], column[x:y] - first] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    link = 100 * common >= percent * (size[:, None] + size[None] - common)
    if across:
        link &= block[:, None] != block[None]
    for i in range(k):
        for j in np.flatnonzero(link[i, :i]):
            union(i, int(j))
    return out


#: Sets of a block: two blocks are what a task compares at once.
BLOCK = 256


def pieces_of(classes: DataFrame, clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """cid, cluster: what is compared with what, each cluster as a whole or bucket by bucket.

    classes: cid, bands; clusters: cid, cluster.  A unit of n sets sends
    n * ceil(n / block) rows of sets.  One of many near copies is compared as a
    whole; a long chain of small buckets, whose cost by buckets grows with its
    length alone, goes by buckets where that takes less than half the rows.
    Only clusters of more than two blocks can, so only their bands are dealt.
    """
    cost = lambda n: F.col(n) * F.ceil(F.col(n) / F.lit(block))
    large = materialise(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block).select("cluster", cost("n").alias("whole")), "large")
    if large.isEmpty():
        return clusters
    own = classes.join(clusters.join(large, "cluster", "left_semi").select("cid", "cluster"), "cid")
    inside = materialise(own.select("cid", "cluster", F.explode("bands").alias("bucket")), "inside")
    members = F.bit_xor(F.xxhash64("cid")).alias("members")  # buckets of the same classes count once
    shared = inside.groupBy("cluster", "bucket").agg(F.count(F.lit(1)).alias("k"), members).where(F.col("k") > 1)
    buckets = materialise(shared.groupBy("cluster", "k", "members").agg(F.min("bucket").alias("bucket")), "buckets")
    parts = buckets.groupBy("cluster").agg(F.sum(cost("k")).alias("parts"))
    chains = materialise(large.join(parts, "cluster").where(2 * F.col("parts") < F.col("whole")).select("cluster"), "chains")
    if chains.isEmpty():
        return clusters
    cut = inside.join(buckets.join(chains, "cluster", "left_semi").select("cluster", "bucket"), ["cluster", "bucket"]).select("cid", F.col("bucket").alias("cluster"))
    return materialise(clusters.join(chains, "cluster", "left_anti").select("cid", "cluster").unionByName(cut), "units")


def links(clusters: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """a, b: links that join all members of clusters which any chain of similar sets joins.

    clusters: cid, cluster.  A cluster is dealt into blocks of about ``block``
    sets, and each pair of blocks is one piece of work, so that a cluster of any
    size is compared as a whole by tasks of bounded size.  What a piece sends on
    are the edges of a spanning forest, fewer than it has sets.
    """
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    dealt = clusters.join(size, "cluster").withColumn("n_blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    work = dealt.select("cid", "cluster", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).join(sets, "cid")
    work = work.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "cid")

    def run(batches):
        key, ids, blocks, items = None, [], [], []

        def solve():
            pairs = joined_pairs(items, np.array(blocks), key[1] != key[2], percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("cluster", "x", "y", "cid", "block")]
            for row, item in zip(zip(*columns, strict=True), b.column("items"), strict=True):
                if key != row[:3]:
                    if len(ids) > 1:
                        yield from solve()
                    key, ids, blocks, items = row[:3], [], [], []
                ids.append(row[3])
                blocks.append(row[4])
                items.append(np.frombuffer(item.as_py(), np.uint64))
        if len(ids) > 1:
            yield from solve()

    return work.mapInArrow(K.tidied(run), "a long, b long")


def group(docs: DataFrame, width: int = 4, percent: int = 80, bands: int = 40, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, uid, n_shingles, rep (the smallest (did, uid) of the component) for each row of docs.

    With 40 bands of 5 places two sets of similarity 0.8 share no band with
    probability 1e-7, and more similar ones with less.
    """
    texts = X.keyed(docs, id_col, text_col)
    marked = materialise(signed(texts, width, bands, rows), "signed")
    classes = materialise(marked.where(F.col("n") > 0).groupBy("cid").agg(F.min(F.struct("did", "uid")).alias("first"), F.first("bands").alias("bands")), "classes")
    spread = classes.select("cid", F.explode("bands").alias("bucket"))
    heads = spread.groupBy("bucket").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("bucket", "head")
    stars = spread.join(heads, "bucket").where(F.col("cid") != F.col("head")).select(F.col("cid").alias("a"), F.col("head").alias("b"))
    clusters = components(stars).toDF("cid", "cluster")
    units = pieces_of(classes, clusters)
    wanted = classes.join(clusters.select("cid"), "cid", "left_semi").select("cid", "first.did", "first.uid")
    sources = texts.join(wanted.hint("shuffle_hash"), ["did", "uid"]).select("cid", "text")
    sets = materialise(sets_of(sources, width).dropDuplicates(["cid"]), "sets")
    roots = components(links(units, sets, percent))
    forget(sets)
    placed = materialise(classes.select("cid", "first").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "first", F.coalesce("root", "cid").alias("root")), "placed")
    reps = placed.groupBy("root").agg(F.min("first").alias("rep"))
    of_class = materialise(looked_up(placed, reps, "root").select("cid", "rep"), "reps")
    both = looked_up(marked.select("did", "uid", "n", "cid"), of_class, "cid")
    return both.select("did", "uid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.struct("did", "uid")).alias("rep"))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    component_id is the smallest doc_id that links reach, kept whether it is
    the row's own.  Texts without words, and null ones, are linked with
    nothing.  Null ids come last: a component of such rows alone has a null
    component_id and keeps them.  Repeated rows share a component.  An empty
    table gives an empty result; other columns are ignored.
    """
    found = group(docs, **options)
    real = lambda c: F.when(c != X.LAST, c)
    return found.select(real(F.col("did")).alias("doc_id"), "n_shingles", real(F.col("rep.did")).alias("component_id"), (F.col("did") == F.col("rep.did")).alias("kept"))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component, all columns as they are, whatever their names.

    It is the row of the smallest id, of those with one id one by a hash of the
    text; of repeated rows one stays.  Texts without words, and null ones, stay,
    as they are linked with nothing; null ids come last.  An empty table gives
    an empty one.
    """
    found = group(docs, id_col=id_col, text_col=text_col, **options)
    names = fresh(docs, "did", "uid")
    keep = found.where((F.col("did") == F.col("rep.did")) & (F.col("uid") == F.col("rep.uid"))).select("did", "uid").distinct().toDF(*names)
    did = F.col(f"`{id_col}`").cast("long")
    rows = docs.withColumn(names[0], F.coalesce(did, F.lit(X.LAST))).withColumn(names[1], F.xxhash64(did, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return rows.join(keep.hint("shuffle_hash"), names, "left_semi").dropDuplicates(names).select(*(F.col(f"`{c}`") for c in docs.columns))
