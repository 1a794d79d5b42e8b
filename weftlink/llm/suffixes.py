"""Byte-level dedup of long repeats by prefix-free parsing.

A rolling hash over a few bytes places triggers that depend on content alone,
so equal strings are parsed alike wherever they stand.  Every window of the
wanted length belongs to the first trigger in it; the phrase before the trigger
is its left side, the phrases after it its right side.

* Triggers are brought together by their right side, as far as every window
  reaches; where that is unique, no window of the trigger is repeated.
* Triggers equal in both sides are repeated as a whole, with all their windows,
  however many copies there are: this settles the bulk of a repetitive corpus.
* Where a right side meets different left sides or ends, at the rims of
  repeats, a bucket holds all the strings in question.  They are parsed into a
  dictionary of distinct phrases and lists of their ranks; the sorted phrase
  suffixes and the sorted parse suffixes, the suffix arrays of both, combine
  into the corpus order of the windows, and neighbours in that order that share
  a whole window are repeats.

So the corpus order is made where repeats begin and end, a bucket at a time;
elsewhere it would only say again what the first two steps have settled.  A
right side with very many different left sides is hot: one bucket can't hold
them all, so their windows are compared one by one by 100-bit fingerprints, as
are windows without a trigger near, as in monotonous text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import materialise

TRIGGER = 12
SURE, CHECK, BOTH, HIT, ORDER, KNOWN = 1, 2, 3, 4, 5, 6
PIECE = 2  # a flag of entries that are strings, not windows
SIDES, MOST = 8, 4096  # left sides of one right side: of a batch, and in all, that are put in order
_LEFT = (K.U64(0x9E3779B97F4A7C15), K.U64(0xD1B54A32D192ED03))


def triggers(raw: np.ndarray, at: np.ndarray, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where triggers start, and the texts they are in; about eight to a window."""
    if len(raw) < TRIGGER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = K.rolling_zeros(sums, TRIGGER, max(8, length // 8))
    doc = np.searchsorted(at, found, "right") - 1
    whole = found + TRIGGER <= at[doc + 1]
    return found[whole], doc[whole]


def reaches(length: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """How far before its trigger a window starts, in two bands; windows of a band share what follows the trigger."""
    return (0, length - (length * 16) // 25), (length - (length * 16) // 25 + 1, length - length // 4)


def parse(texts: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """Pairs of first and last window start, of all windows that can be repeated, by kind as k1, k2, k3, k5 and k6.

    SURE: repeated.  ORDER: to be put in corpus order.  KNOWN: repeated, and to
    be put in order for others' sake.  CHECK and BOTH are the same for windows
    that are compared one by one: those of a hot right side, and those without
    a trigger near.
    """
    reach = reaches(length)

    def send(raw, at, _):
        sums, other = K.byte_sums(raw, 0), K.byte_sums(raw, 1)
        t, doc = triggers(raw, at, sums, length)
        before = np.concatenate([[-1], t[:-1]]) if len(t) else t
        first = np.maximum(before + 1, at[doc])
        d_hi, d_lo = t - first, np.maximum(0, t - (at[doc + 1] - length))
        answers, parts = [], []
        for band, (lo, hi) in enumerate(reach):
            a, b = np.maximum(d_lo, lo), np.minimum(d_hi, hi)
            k = np.flatnonzero(a <= b)
            both = K.spans(other, t[k] - b[k], t[k] - a[k] + length, 1)
            parts.append((_right(sums, t[k], band, hi, length), K.mixed(both + a[k].astype(K.U64) * _LEFT[0] + b[k].astype(K.U64) * _LEFT[1]), doc[k], t[k] - at[doc[k]], a[k], b[k]))
        # windows far before their trigger, and those behind a text's last one
        far = np.maximum(d_lo, reach[-1][1] + 1)
        k = np.flatnonzero(far <= d_hi)
        answers.append((doc[k], CHECK, np.stack([t[k] - d_hi[k], t[k] - far[k]], 1) - at[doc[k], None]))
        last = at[:-1] - 1
        np.maximum.at(last, doc, t)
        k = np.flatnonzero(last + 1 <= at[1:] - length)
        answers.append((k, CHECK, np.stack([last[k] + 1, at[k + 1] - length], 1) - at[k, None]))
        right, both, doc, t, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        span = np.stack([t - hi, t - lo], 1)
        order, new = X.groups(right, both)
        size = np.diff(np.append(new, len(order)))
        copies = np.ones(len(order), bool)
        copies[new] = False
        answers.append((doc[order[copies]], SURE, span[order[copies]]))
        # a few different left sides of a right side are sent; with more it is hot, and all of it is compared window by window
        rep, again = order[new], size > 1
        by = np.lexsort((~again, right[rep]))
        rep, again = rep[by], again[by]
        head = np.flatnonzero(np.concatenate([[True], right[rep[1:]] != right[rep[:-1]]])) if len(rep) else rep
        sides = np.diff(np.append(head, len(rep)))
        nth, many = np.arange(len(rep)) - np.repeat(head, sides), np.repeat(sides > SIDES, sides)
        rest = nth >= SIDES
        for kind, which in ((BOTH, rest & again), (CHECK, rest & ~again)):
            answers.append((doc[rep[which]], kind, span[rep[which]]))
        go, flag = rep[~rest], (again | (many << 1))[~rest]
        entries = X.Entries(right[go], [both[go], flag.astype(np.uint8), lo[go].astype("<u2"), hi[go].astype("<u2")], doc[go], t[go])
        return entries, X.together(answers)

    def decide(e, _):
        both, flag, lo, hi = e.extra
        span = np.stack([e.at - hi.astype(np.int64), e.at - lo.astype(np.int64)], 1)
        order, new = X.groups(e.key, both)
        if not len(order):
            return X.together([(e.doc, SURE, span)])
        size = np.diff(np.append(new, len(order)))
        again = (size > 1) | (np.maximum.reduceat(flag[order] & 1, new) > 0)
        key = e.key[order[new]]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sides = np.diff(np.append(head, len(key)))
        hot = (sides > MOST) | np.logical_or.reduceat(np.logical_or.reduceat(flag[order] > 1, new), head)
        mixed, hot = np.repeat(sides > 1, sides), np.repeat(hot, sides)
        leads = np.zeros(len(order), bool)
        leads[new] = True
        again, mixed, hot = np.repeat(again, size), np.repeat(mixed, size), np.repeat(hot, size)
        cases = ((SURE, again & ~((mixed | hot) & leads)), (BOTH, again & hot & leads), (CHECK, ~again & hot), (KNOWN, again & mixed & ~hot & leads), (ORDER, ~again & mixed & ~hot))
        return X.together([(e.doc[order[c]], kind, span[order[c]]) for kind, c in cases])

    return X.run(texts, [], n_buckets, send, decide, ("<u8", "u1", "<u2", "<u2"), (SURE, CHECK, BOTH, ORDER, KNOWN))


def _right(sums: np.ndarray, t: np.ndarray, band: int, hi: int, length: int) -> np.ndarray:
    """A key of what follows a trigger, as far as all windows of a band reach."""
    return K.mixed(K.spans(sums, t, t + length - hi) + K.U64(band))


def phrases(piece: bytes, triggers_at: list[int]) -> list[bytes]:
    """The piece cut at its triggers; a phrase ends with the trigger that the next one begins with."""
    cuts = [0, *(t for t in triggers_at if t), len(piece)]
    return [piece[a : b + TRIGGER] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def ranked(items: list) -> np.ndarray:
    """The rank of each item among the distinct ones in their order."""
    place = {x: i for i, x in enumerate(sorted(set(items)))}
    return np.array([place[x] for x in items], np.int64)


def corpus_order(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, alike) of all windows in the order of the suffixes that they begin.

    The pieces, each with its windows' first trigger, are parsed into phrases.
    The distinct phrases, sorted, are the dictionary, and a piece is the list of
    their ranks: the parse.  A window is the suffix of a dictionary phrase, up
    to its trigger, and the suffix of the parse that follows.  The sorted
    phrase suffixes are the dictionary's suffix array; the sorted parse
    suffixes that begin with a window's trigger are the parse's.  Two windows
    compare as their places in the first, which is prefix-free, then in the
    second.  alike: whether a window shares all its bytes with the one before.
    """
    raw, at = K.text_bytes(pa.array(pieces, pa.binary()))
    t, owner = triggers(raw, at, K.byte_sums(raw), length)
    edge = np.searchsorted(owner, np.arange(len(pieces) + 1))
    t -= at[owner]
    starts = (np.diff(at) - length + 1).astype(np.int64)
    firsts, heads, tails = [], [], []
    for i, piece in enumerate(pieces):
        cuts = t[edge[i] : edge[i + 1]].tolist()
        firsts.append(cuts[0])
        heads.append(piece[: cuts[0] + TRIGGER])
        tails.append(phrases(piece[cuts[0] :], [c - cuts[0] for c in cuts]))
    dictionary = {p: i for i, p in enumerate(sorted({p for tail in tails for p in tail}))}
    parse_rank = ranked([tuple(dictionary[p] for p in tail) for tail in tails])
    # the suffixes of a phrase that windows begin with; phrases that end alike share them
    longest: dict[bytes, int] = {}
    for head, n in zip(heads, starts.tolist(), strict=True):
        longest[head] = max(longest.get(head, 0), n)
    suffix = {s: i for i, s in enumerate(sorted({head[k:] for head, n in longest.items() for k in range(n)}))}
    places = {head: np.array([suffix[head[k:]] for k in range(n)], np.int64) for head, n in longest.items()}
    piece = np.repeat(np.arange(len(pieces)), starts)
    start = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    suffix_rank = np.concatenate([places[head][:n] for head, n in zip(heads, starts.tolist(), strict=True)])
    order = np.lexsort((parse_rank[piece], suffix_rank))
    piece, start, suffix_rank = piece[order], start[order], suffix_rank[order]
    # the common prefix of neighbours: the same phrase suffix, and equal bytes as far as a window reaches
    alike = np.zeros(len(order), bool)
    near = np.flatnonzero(suffix_rank[1:] == suffix_rank[:-1]) + 1
    views = np.lib.stride_tricks.sliding_window_view(raw, length)
    absolute = at[piece] + start
    for a in range(0, len(near), 1 << 14):
        k = near[a : a + (1 << 14)]
        alike[k] = (views[absolute[k]] == views[absolute[k - 1]]).all(1)
    return piece, start, alike


def _spans(batch: pa.RecordBatch, name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first and last window start in the batch) of the pairs in a column."""
    lists = batch.column(name)
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)) // 2)
    return owner, np.asarray(lists.flatten(), np.int64).reshape(-1, 2) + at[owner, None]


def _expand(batch: pa.RecordBatch, name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, window start in the batch) of all windows in a column of pairs."""
    owner, pair = _spans(batch, name, at)
    n = pair[:, 1] - pair[:, 0] + 1
    return np.repeat(owner, n), np.repeat(pair[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def rims(texts: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """texts with the spans of parse(): the starts of the repeated windows as k4 (HIT).

    A span to be put in order travels as the string that its windows cover, to
    the bucket of what follows its trigger, so that all equal windows are put in
    order together.  Other spans travel as their windows' fingerprints.
    """
    reach = reaches(length)

    def send(raw, at, batch):
        sums, other = K.byte_sums(raw, 0), K.byte_sums(raw, 1)
        (doc_a, a), (doc_b, b) = _expand(batch, f"k{CHECK}", at), _expand(batch, f"k{BOTH}", at)
        doc, start, known = np.concatenate([doc_a, doc_b]), np.concatenate([a, b]), np.repeat([False, True], [len(a), len(b)])
        one, two = K.spans(sums, start, start + length, 0), K.spans(other, start, start + length, 1)
        order, new = X.groups(one, two)
        size = np.diff(np.append(new, len(order)))
        again = (size > 1) | (np.logical_or.reduceat(known[order], new) if len(new) else np.zeros(0, bool))
        hit = order[np.repeat(again, size) & ~known[order]]
        rep = order[new]
        answers = X.together([(doc[hit], HIT, (start[hit] - at[doc[hit]])[:, None])])
        (own_a, span_a), (own_b, span_b) = _spans(batch, f"k{ORDER}", at), _spans(batch, f"k{KNOWN}", at)
        own, span, sure = np.concatenate([own_a, own_b]), np.concatenate([span_a, span_b]), np.repeat([0, 1], [len(own_a), len(own_b)])
        t, _ = triggers(raw, at, sums, length)
        trigger = t[np.searchsorted(t, span[:, 0])] if len(own) else span[:, 0]
        band = (trigger - span[:, 0] > reach[0][1]).astype(np.int64)
        right = np.zeros(len(own), K.U64)
        for i, (_, hi) in enumerate(reach):
            mine = band == i
            right[mine] = _right(sums, trigger[mine], i, hi, length)
        data = raw.tobytes()
        pieces = [data[x:y] for x, y in zip(span[:, 0].tolist(), (span[:, 1] + length).tolist(), strict=True)]
        cat = lambda x, y: np.concatenate([x, y])
        flags = cat(again.astype(np.uint8), (PIECE | sure).astype(np.uint8))
        entries = X.Entries(cat(one[rep], right), [cat(two[rep], np.zeros(len(own), K.U64)), flags], cat(doc[rep], own), cat(start[rep] - at[doc[rep]], span[:, 0] - at[own]), [b""] * len(rep) + pieces)
        return entries, answers

    def decide(e, _):
        whole = np.flatnonzero((e.extra[1] & PIECE) == 0)
        two, flag = e.extra[0][whole], e.extra[1][whole]
        order, new = X.groups(e.key[whole], two)
        size = np.diff(np.append(new, len(order)))
        again = (size > 1) | ((np.maximum.reduceat(flag[order], new) if len(new) else np.zeros(0)) > 0)
        hit = whole[order[np.repeat(again, size) & (flag[order] == 0)]]
        answers = [(e.doc[hit], HIT, e.at[hit, None])]
        spans = np.flatnonzero(e.extra[1] & PIECE)
        if len(spans):
            piece, start, alike = corpus_order([e.pieces[i] for i in spans], length)
            repeated = alike.copy()
            repeated[:-1] |= alike[1:]
            mine = spans[piece]
            repeated &= (e.extra[1][mine] & 1) == 0
            mine, start = mine[repeated], start[repeated]
            answers.append((e.doc[mine], HIT, (e.at[mine] + start)[:, None]))
        return X.together(answers)

    return X.run(texts, [f"k{k}" for k in (CHECK, BOTH, ORDER, KNOWN)], n_buckets, send, decide, ("<u8", "u1"), (HIT,))


def repeats(texts: DataFrame, n_buckets: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Repeated windows: (did, uid, k1, k3, k6: pairs of first and last start) and (did, uid, k4: starts)."""
    parsed = materialise(parse(texts, n_buckets, length), "parse")
    kinds = [f"k{k}" for k in (CHECK, BOTH, ORDER, KNOWN)]
    open_spans = parsed.where(sum((F.size(k) for k in kinds), F.lit(0)) > 0).select("did", "uid", *kinds)
    hits = materialise(rims(texts.join(open_spans.hint("shuffle_hash"), ["did", "uid"]), n_buckets, length), "rims")
    return parsed.select("did", "uid", *(f"k{k}" for k in (SURE, BOTH, KNOWN))), hits


def _dead(batch: pa.RecordBatch, at: np.ndarray, length: int) -> np.ndarray:
    """Which bytes lie in a repeated window."""
    first, last = [], []
    for name in (f"k{SURE}", f"k{BOTH}", f"k{KNOWN}", f"k{HIT}"):
        lists, width = batch.column(name), 1 if name == f"k{HIT}" else 2
        owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)) // width)
        spans = np.asarray(lists.flatten(), np.int64).reshape(-1, width) + at[owner, None]
        first.append(spans[:, 0])
        last.append(spans[:, -1] + length)
    return X.covered(int(at[-1]), np.concatenate(first), np.concatenate(last))


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Remove every byte in a string of ``length`` bytes that also starts elsewhere.

    Texts are taken as UTF-8; strings don't cross documents, are judged on the
    input and lose all their copies.  Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 (of the bytes left) and
    kept_text: the text without the characters that are removed as a whole, so
    that a character cut by a span stays.  keep: further columns to carry.

    A null text is an empty one.  Rows with the same id are different
    documents, so a repeated row loses what is long enough.  Null ids stay
    null.  Shorter texts lose nothing.
    """
    keep = keep or []
    texts, n = X.keyed(docs, id_col, text_col), X.buckets_for(docs)
    whole, single = repeats(texts, n, length)
    did, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(did.alias("doc_id"), text.alias("text"), F.coalesce(did, F.lit(X.LAST)).alias("did"), F.xxhash64(did, text).alias("uid"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)))
    joined = rows.join(whole.hint("shuffle_hash"), ["did", "uid"], "left").join(single.hint("shuffle_hash"), ["did", "uid"], "left").drop("did", "uid")
    fixed = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    carried = [f"keep_{i}" for i in range(len(keep))]

    def cut(batches):
        for b in K.slices(batches):
            raw, at = K.text_bytes(b.column("text"))
            dead = _dead(b, at, length)
            begins = dead.copy()
            begins[1:] &= ~dead[:-1]
            begins[at[:-1][np.diff(at) > 0]] = dead[at[:-1][np.diff(at) > 0]]
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            whole = np.logical_and.reduceat(dead, lead) if len(lead) else dead[:0]
            left = ~np.repeat(whole, np.diff(np.append(lead, len(raw)))) if len(lead) else ~dead
            digests, texts, gone, runs = [], [], [], []
            for i in range(b.num_rows):
                s = slice(at[i], at[i + 1])
                digests.append(hashlib.sha256(raw[s][~dead[s]].tobytes()).hexdigest())
                texts.append(raw[s][left[s]].tobytes().decode("utf-8", "replace"))
                gone.append(int(dead[s].sum()))
                runs.append(int(begins[s].sum()))
            columns = [b.column("doc_id"), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [b.column(c) for c in carried], fixed + carried)

    kinds = {f.name: f.dataType for f in rows.schema}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in fixed[1:4]), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()), *(T.StructField(c, kinds[c]) for c in carried)])
    out = joined.mapInArrow(K.tidied(cut), schema)
    return out.select(*fixed, *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))


def dedup_rows(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, whatever their names, their texts without long repeats.

    A null text becomes an empty one; repeated rows stay repeated and lose what
    is long enough, null ids stay null, and an empty table gives an empty one.
    """
    cut = dedup(docs, length, id_col, text_col, keep=docs.columns)
    places = {c: i for i, c in enumerate(docs.columns)}
    fixed = 6
    renamed = cut.toDF(*(f"f{i}" for i in range(fixed)), *(f"k{i}" for i in range(len(docs.columns))))
    return renamed.select(*((F.col("f5") if c == text_col else F.col(f"k{i}")).alias(c) for c, i in places.items()))
