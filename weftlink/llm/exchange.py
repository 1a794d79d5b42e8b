"""A shuffle of packed fingerprints.

Finding equal spans in a corpus means bringing equal fingerprints together,
and there are as many as words or bytes.  As rows they would cost tens of bytes
and a microsecond each; here a task packs those bound for one bucket into a few
binary columns, so that an entry costs its fingerprint and two bytes.

Answers go back packed as well, to the bucket of their document.

A task first combines what it holds itself: of equal fingerprints it sends one
or two and settles the others on the spot.  However often a span is repeated,
a bucket gets at most that many entries of it from each batch of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Bytes of text that a task handles at once.
BATCH = 1 << 21
LAST = (1 << 63) - 1
PACKED = "bucket int, n int, keys binary, extra binary, gaps binary, docs binary, pieces binary, answers binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("keys", "extra", "gaps", "docs", "pieces", "answers"))])
_ANSWERS = pa.schema([("bucket", pa.int32()), ("answers", pa.binary())])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, uid, text: keys that tell documents apart even where ids are null or repeated.

    Rows with the same id and text are one document.
    """
    did, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(did, F.lit(LAST)).alias("did"), F.xxhash64(did, text).alias("uid"), text.alias("text"))


def buckets_for(docs: DataFrame) -> int:
    """Buckets of a bounded size: their number follows the bytes that the scan reads.

    A bucket stands for ``weftlink.bucketBytes`` of input, 16 MB if the session
    doesn't say otherwise.  Larger executors take larger buckets, and fewer of
    them keep more entries together in a row.
    """
    spark = docs.sparkSession
    size = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    per = max(1, round(size / _bytes(spark.conf.get("weftlink.bucketBytes", "16m"))))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per * docs.rdd.getNumPartitions())


def _bytes(setting: str) -> float:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = setting.lower().removesuffix("b") or "0"
    return float(number[:-1]) * units[number[-1]] if number[-1] in units else float(number)


@dataclass
class Entries:
    """Fingerprints of one batch or bucket.

    key: 64 bits of which a bucket keeps 40 besides its number; extra: columns
    of the given dtypes; doc: number of the document; at: place in it; pieces:
    strings of up to 64 KB that go with the entries, none if there are none.
    """

    key: np.ndarray
    extra: list
    doc: np.ndarray
    at: np.ndarray
    pieces: list[bytes] | None = None


@dataclass
class Docs:
    did: np.ndarray
    uid: np.ndarray


def pack(entries: Entries, docs: Docs, n_buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(entries.key):
        return
    order = np.lexsort((entries.at, entries.doc))
    bucket = ((entries.key[order] & K.U64(0xFFFFFF)) % K.U64(n_buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    order, bucket = order[by], bucket[by]
    names, first = np.unique(bucket, return_index=True)
    rows = []
    for b, take in zip(names, np.split(order, first[1:]), strict=True):
        doc, at = entries.doc[take], entries.at[take]
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        gap = np.diff(at, prepend=0)
        gap[new] = at[new]
        used = doc[new]
        table = np.concatenate([docs.did[used], docs.uid[used], np.diff(np.append(new, len(doc)))]).astype("<i8")
        rows.append(
            {
                "bucket": int(b),
                "n": len(take),
                "keys": (entries.key[take] >> K.U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes(),
                "extra": b"".join(x[take].tobytes() for x in entries.extra),
                "gaps": gap.astype("<u2" if gap.max(initial=0) < 65536 else "<u4").tobytes(),
                "docs": table.tobytes(),
                "pieces": _joined([entries.pieces[i] for i in take]) if entries.pieces is not None else None,
                "answers": None,
            }
        )
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _PACKED)


def _joined(pieces: list[bytes]) -> bytes:
    return np.array([len(p) for p in pieces], "<u2").tobytes() + b"".join(pieces)


def _parted(joined: bytes, n: int) -> list[bytes]:
    ends = (2 * n + np.cumsum(np.frombuffer(joined, "<u2", n), dtype=np.int64)).tolist()
    return [joined[a:b] for a, b in zip([2 * n, *ends], ends, strict=False)]


def settled(docs: Docs, doc: np.ndarray, kind: np.ndarray, spans: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Answers packed for the buckets of their documents; spans has one row of numbers for each answer."""
    if not len(doc):
        return
    to = (K.mixed(docs.uid.astype(K.U64)) % K.U64(n_buckets)).astype(np.int32)
    order = np.lexsort((kind, doc, to[doc]))
    doc, kind, spans = doc[order], kind[order], spans[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])]))
    size = np.diff(np.append(new, len(doc))) * spans.shape[1]
    at, flat = new * spans.shape[1], spans.astype("<i4").ravel()
    target = to[doc[new]]
    cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(new)), strict=True):
        own = doc[new[a:b]]
        head = np.concatenate([docs.did[own], docs.uid[own], kind[new[a:b]], size[a:b]]).astype("<i8")
        yield int(target[a]), np.array([b - a], "<i8").tobytes() + head.tobytes() + flat[at[a] : at[b - 1] + size[b - 1]].tobytes()


def merged(packed: list[bytes], kinds: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """One row for each document: did, uid, and its spans of each kind."""
    heads, spans = [], []
    for x in packed:
        n = int(np.frombuffer(x, "<i8", 1)[0])
        heads.append(np.frombuffer(x, "<i8", 4 * n, 8).reshape(4, n))
        spans.append(np.frombuffer(x, "<i4", -1, 8 + 32 * n))
    if not heads:
        return
    did, uid, kind, size = np.concatenate(heads, 1)
    flat, start = np.concatenate(spans), np.cumsum(size) - size
    order, new = groups(did, uid)
    number = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    columns = [pa.array(did[order[new]]), pa.array(uid[order[new]])]
    for k in kinds:
        mine = kind[order] == k
        take, owner = order[mine], number[mine]
        n = size[take]
        index = np.repeat(start[take], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        columns.append(K.list_array(flat[index], np.bincount(owner, n, len(new)).astype(np.int64)))
    whole = pa.RecordBatch.from_arrays(columns, ["did", "uid", *(f"k{k}" for k in kinds)])
    for at in range(0, whole.num_rows, 4096):
        yield whole.slice(at, 4096)


def unpack(rows: list[dict], dtypes: tuple) -> tuple[Entries, Docs]:
    keys, extra, numbers, places, dids, uids, pieces, base = [], [[] for _ in dtypes], [], [], [], [], [], 0
    for r in rows:
        n = r["n"]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(r["keys"], np.uint8).reshape(5, n).T
        keys.append(wide.view("<u8")[:, 0])
        at = 0
        for x, t in zip(extra, dtypes, strict=True):
            x.append(np.frombuffer(r["extra"], t, n, at))
            at += n * np.dtype(t).itemsize
        did, uid, counts = np.frombuffer(r["docs"], "<i8").reshape(3, -1)
        gap = np.frombuffer(r["gaps"], "<u2" if len(r["gaps"]) == 2 * n else "<u4").astype(np.int64)
        total = np.cumsum(gap)
        start = np.cumsum(counts) - counts
        places.append((total - np.repeat(total[start] - gap[start], counts)).astype(np.int32))
        numbers.append(np.repeat(np.arange(base, base + len(did), dtype=np.int32), counts))
        dids.append(did)
        uids.append(uid)
        base += len(did)
        if r["pieces"] is not None:
            pieces += _parted(r["pieces"], n)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return Entries(cat(keys, np.uint64), [cat(x, t) for x, t in zip(extra, dtypes, strict=True)], cat(numbers, np.int32), cat(places, np.int32), pieces), Docs(cat(dids, np.int64), cat(uids, np.int64))


def run(texts: DataFrame, carry: list[str], n_buckets: int, send: Callable, decide: Callable, dtypes: tuple, kinds: tuple[int, ...]) -> DataFrame:
    """One round: texts (did, uid, text and carry) -> did, uid, k<kind> for documents with answers.

    send(raw, edges, batch) gives (Entries, answers); decide(Entries, Docs)
    gives answers.  Answers are (document numbers, kinds, spans).  Entries
    travel to the bucket of their fingerprint, answers to that of their document.
    """

    def scatter(batches):
        for b in K.slices(batches, most=BATCH):
            docs = Docs(np.asarray(b.column("did")), np.asarray(b.column("uid")))
            entries, answers = send(*K.text_bytes(b.column("text")), b)
            rows = [{"bucket": to, "answers": x} for to, x in settled(docs, *answers, n_buckets)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PACKED)
            yield from pack(entries, docs, n_buckets)

    def gather(batches):
        packed = []
        for b in batches:
            own = np.asarray(b.column("n").is_null())
            if own.any():
                yield b.filter(pa.array(own)).select(["bucket", "answers"])
            if not own.all():
                packed += b.filter(pa.array(~own)).select(["n", "keys", "extra", "gaps", "docs", "pieces"]).to_pylist()
        if packed:
            entries, docs = unpack(packed, dtypes)
            packed.clear()
            rows = [{"bucket": to, "answers": x} for to, x in settled(docs, *decide(entries, docs), n_buckets)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ANSWERS)

    def collect(batches):
        yield from merged([x for b in batches for x in b.column("answers").to_pylist()], kinds)

    sent = texts.select("did", "uid", "text", *carry).mapInArrow(K.tidied(scatter), PACKED)
    heard = sent.repartitionById(n_buckets, F.col("bucket")).mapInArrow(K.tidied(gather), "bucket int, answers binary")
    schema = "did long, uid long, " + ", ".join(f"k{k} array<int>" for k in kinds)
    return heard.repartitionById(n_buckets, F.col("bucket")).mapInArrow(K.tidied(collect), schema)


def together(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join answers given as (doc, kind, spans), kind a number."""
    return (
        np.concatenate([np.asarray(d, np.int64) for d, _, _ in parts]),
        np.concatenate([np.full(len(d), k, np.int8) for d, k, _ in parts]),
        np.concatenate([np.asarray(s, np.int32) for _, _, s in parts]),
    )


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any span."""
    edges = np.bincount(starts, minlength=n + 1)
    edges -= np.bincount(ends, minlength=n + 1)
    return np.cumsum(edges, out=edges)[:n] > 0


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together (stable), and where each group starts in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


