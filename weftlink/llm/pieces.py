"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file:

* the normaliser: a trie whose paths spell what the model's character map
  rewrites, with the rewritten text as output, and states for spaces (at the
  start, behind a space, behind text) that drop surplus ones, add the dummy
  prefix and write the space symbol;
* the piece transducer: a trie whose paths spell pieces and whose finals carry
  their weights, with byte fallback (or the unknown piece) for characters that
  no piece begins with;
* the neighbour acceptor, for models of kind BPE: it gives weight 0 to two
  pieces that merging would leave side by side and infinity to others.  The
  scores of such a model are merge ranks, whose sum means nothing; with the
  acceptor the one finite path is what merging by rank gives.  Unigram models
  need none: their weights are negative log-probabilities.

An input is composed with them position by position, and the shortest path in
the tropical semiring (minimum, plus) is its encoding.  Where no piece spans
the boundary before a space symbol, the path runs through each boundary, so
words are solved one at a time and remembered; otherwise whole texts are.
Runs of letters and of other characters that stand together in no piece are
words of their own.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SPACE = "▁"
INF = float("inf")
FINAL = ""
_KEEP = 200_000  # words, and neighbour pairs, that a worker remembers


def trie(words: dict) -> tuple:
    """A state is (the word's value that ends in it, or None; its arcs by character)."""
    build: dict = {}
    for word, value in words.items():
        node = build
        for c in word:
            node = node.setdefault(c, {})
        node[FINAL] = value

    def state(node: dict) -> tuple:
        return node.get(FINAL), {c: state(x) for c, x in node.items() if c != FINAL}

    return state(build)


def character_map(blob: bytes) -> dict[str, str]:
    """What a model's compiled character map rewrites: a double array of byte arcs, and the texts that its leaves point at.

    A unit holds its label in the low byte, whether a leaf hangs on it in bit 8,
    and the offset of its children above; all nodes of one depth are read at once.
    """
    if not blob:
        return {}
    size = int(np.frombuffer(blob, "<u4", 1)[0])
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]

    def children(unit):
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    labels = np.arange(1, 256)
    base, keys, found = children(units[:1]), [b""], {}
    while len(base):
        at = base[:, None] ^ labels
        at = np.where(at < len(units), at, 0)
        row, column = np.nonzero((units[at] & 0x800000FF) == labels)
        node = at[row, column]
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), column.tolist(), strict=True)]
        below = (node ^ children(units[node])) if len(node) else node
        for i in np.flatnonzero((units[node] >> 8) & 1).tolist():
            start = int(units[below[i]] & 0x7FFFFFFF)
            found[keys[i].decode()] = texts[start : texts.index(b"\0", start)].decode()
        base = below
    return found


class Normaliser:
    """The normaliser of a model as a machine: longest rewritten match first, then states for spaces."""

    def __init__(self, spec, symbols: list[str] = (), suffix: bool = False):
        rewritten = character_map(spec.precompiled_charsmap)
        self.symbols = trie({x: x for x in symbols})
        self.arcs = trie(rewritten)
        self.prefix, self.squeeze, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        self.space = SPACE if spec.escape_whitespaces else " "
        begins = {x[0] for x in (*rewritten, *symbols) if x}
        # characters that begin no arc stay as they are, so stretches of them are copied whole
        self.stop = re.compile(f"[{re.escape(''.join(sorted(begins | {' '})))}]") if begins or self.squeeze else None

    def _longest(self, start: tuple, text: str, at: int) -> tuple[int, str | None]:
        end, out, arcs, k = at, None, start[1], at
        while k < len(text) and (state := arcs.get(text[k])) is not None:
            k += 1
            if state[0] is not None:
                end, out = k, state[0]
            arcs = state[1]
        return end, out

    def compose(self, text: str) -> str:
        """The output of the machine's one path for a text."""
        if self.stop is None:
            out = text
        else:
            parts, at, behind_space = [], 0, self.squeeze
            while at < len(text):
                found = self.stop.search(text, at)
                end = found.start() if found else len(text)
                if end > at:
                    parts.append(text[at:end])
                    at, behind_space = end, False
                    continue
                end, out = self._longest(self.symbols, text, at)
                if out is None:
                    end, out = self._longest(self.arcs, text, at)
                if out is None:
                    end, out = at + 1, text[at]
                if behind_space:
                    out = out.lstrip(" ")
                if out:
                    parts.append(out)
                    behind_space = self.squeeze and out.endswith(" ")
                at = end
            out = "".join(parts)
            if self.squeeze:
                out = out.rstrip(" " + self.space)
        if self.prefix and out:
            out = out + " " if self.suffix else " " + out
        return out.replace(" ", self.space)


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models can be compiled")
        self.bpe = proto.trainer_spec.model_type == 2
        kinds = {"normal": 1, "unknown": 2, "user": 4, "unused": 5, "byte": 6}
        symbols = [p.piece for p in proto.pieces if p.type == kinds["user"]]
        self.normaliser = Normaliser(proto.normalizer_spec, symbols, proto.trainer_spec.treat_whitespace_as_suffix)
        self.text = [p.piece for p in proto.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds["byte"]}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds["unknown"])
        spelled = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds["normal"], kinds["user"], kinds["unused"])}
        scores = [p.score for p in proto.pieces if p.type == kinds["normal"]]
        self.weight = {i: -p.score for i, p in enumerate(proto.pieces)}
        if not self.bpe:
            for i, p in enumerate(proto.pieces):
                if p.type == kinds["user"]:
                    self.weight[i] = -(len(p.piece) * max(scores) - 0.1)
        self.rank = {s: proto.pieces[i].score for s, i in spelled.items()}
        self.id = {s: i for s, i in spelled.items() if self.bpe or proto.pieces[i].type != kinds["unused"]}
        self.no_piece = -(min(scores, default=0.0) - 10)
        self.trie = trie(self.id)
        self.longest = max(map(len, self.id), default=0)
        # a boundary between two characters that no piece spans is on every path
        self.spanned = {s[k : k + 2] for s in self.id for k in range(len(s) - 1)}
        self.by_word = not any(b == SPACE and a != SPACE for a, b in self.spanned)
        main, rest = self._families()
        families = [f"{SPACE}*[{re.escape(x)}]+" for x in (main, rest) if x]
        self.word = re.compile("|".join([*families, f"{SPACE}+", "."]), re.DOTALL)
        self.written = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds["byte"] else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self._pairs: dict[int, bool] = {}
        self._words: dict = {}
        self._older: dict = {}

    def _families(self) -> tuple[str, str]:
        """Characters that pieces chain together most widely, such as letters, and all others that pieces join."""
        parent: dict = {}

        def find(c: str) -> str:
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for a, b in (p for p in self.spanned if SPACE not in p):
            parent[find(a)] = find(b)
        for a, b in self.spanned:
            for c in (a, b):
                if c != SPACE:
                    find(c)
        sizes: dict = {}
        for c in parent:
            sizes.setdefault(find(c), []).append(c)
        main = max(sizes.values(), key=lambda x: (len(x), x), default=[])
        return "".join(sorted(main)), "".join(sorted(set(parent) - set(main)))

    def merged(self, s: str) -> list[str]:
        """Merge the best-ranked neighbours of a short string until none is left; the leftmost first among equals."""
        parts = list(s)
        while True:
            best, where = -INF, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and r > best:
                    best, where = r, k
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def beside(self, key: int, left: str, right: str) -> bool:
        """Whether the neighbour acceptor's weight for two pieces in a row is 0; else it is infinite."""
        if len(self._pairs) >= _KEEP:
            self._pairs.clear()
        got = self._pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def shortest(self, s: str) -> list[int]:
        """The ids on the shortest path of the composition with a normalised string."""
        starts, pieces = (self._beside_path if self.bpe else self._weighted_path)(s, len(s))
        if -1 not in pieces:
            return pieces
        return list(chain.from_iterable([piece] if piece >= 0 else self.fallback(s[start]) for start, piece in zip(starts, pieces, strict=True)))

    def _weighted_path(self, s: str, n: int) -> tuple[list[int], list[int]]:
        """Starts and pieces along the path of least weight; piece -1 is a character that no piece spells."""
        pieces, starts, cost = [-1] * (n + 1), [0] * (n + 1), [INF] * (n + 1)
        cost[0] = 0.0
        weight = self.weight
        for at in range(n):
            before, arcs, single = cost[at], self.trie[1], False
            for end in range(at, n):
                state = arcs.get(s[end])
                if state is None:
                    break
                piece, arcs = state
                if piece is not None:
                    single |= end == at
                    if before + weight[piece] < cost[end + 1]:
                        cost[end + 1], pieces[end + 1], starts[end + 1] = before + weight[piece], piece, at
            if not single and before + self.no_piece < cost[at + 1]:
                cost[at + 1], pieces[at + 1], starts[at + 1] = before + self.no_piece, -1, at
        at, path = n, []
        while at:
            path.append(at)
            at = starts[at]
        return [starts[at] for at in reversed(path)], [pieces[at] for at in reversed(path)]

    def _beside_path(self, s: str, n: int) -> tuple[list[int], list[int]]:
        """The same for a BPE model, whose weights are 0 and infinity.

        All finite paths weigh 0, so the first one found is a shortest one; there
        is no other, as merging has one result.  The search goes along the
        longest arc first and remembers positions that lead nowhere, so it looks
        at few positions besides those on the path.
        """
        first, pairs, longest = self.trie[1], self._pairs, self.longest
        starts, pieces, ways, dead = [], [], [], set()
        at, last, arcs = 0, -3, None
        while at < n:
            if arcs is None:  # (end, piece) of the arcs that start here, the shortest first
                arcs, states, end = [], first, at
                for c in s[at : at + longest]:
                    state = states.get(c)
                    if state is None:
                        break
                    end += 1
                    piece, states = state
                    if piece is not None:
                        arcs.append((end, piece))
                if not arcs or arcs[0][0] > at + 1:
                    arcs.insert(0, (at + 1, -1))
            while arcs:
                end, piece = arcs.pop()
                if end in dead:
                    continue
                if last == -1 or piece == -1:  # a character without a piece has no number to be remembered by
                    left = [s[starts[-1] : at]] if starts else []
                    fits = self.merged("".join(left) + s[at:end]) == [*left, s[at:end]]
                else:
                    key = ((last + 3) << 20) + piece
                    fits = pairs.get(key)
                    if fits is None:
                        fits = self.beside(key, s[starts[-1] : at] if starts else "", s[at:end])
                if fits:
                    starts.append(at)
                    pieces.append(piece)
                    ways.append(arcs)
                    at, last, arcs = end, piece, None
                    break
            else:
                dead.add(at)
                at, arcs = starts.pop(), ways.pop()
                pieces.pop()
                last = pieces[-1] if pieces else -3
        return starts, pieces

    def fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "replace")] if len(self.byte) == 256 else [self.unknown]

    def solved(self, s: str) -> list[int]:
        """The ids of a word, from those seen lately or along its path."""
        got = self._older.get(s) or self.shortest(s)
        if len(s) <= 64:
            if len(self._words) >= _KEEP:  # words not seen since the last time are forgotten
                self._words, self._older = {}, self._words
            self._words[s] = got
        return got

    def forget(self) -> None:
        """Give back the memory of remembered words, which the machines don't need."""
        self._words, self._older = {}, {}
        self._pairs.clear()

    def encode(self, text: str) -> list[int]:
        s = self.normaliser.compose(text)
        if not self.by_word:
            return self.shortest(s)
        words = self.word.findall(s)
        found = list(map(self._words.get, words))
        if None in found:
            found = [x or self.solved(w) for x, w in zip(found, words, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids) -> str:
        out = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        n = self.normaliser
        if n.prefix and n.suffix:
            return out.removesuffix(" ")
        return out.removeprefix(" ") if n.prefix else out


_compiled: dict[str, Transducer] = {}


def _transducer(name: str) -> Transducer:
    if name not in _compiled:
        _compiled[name] = Transducer(open(SparkFiles.get(name), "rb").read())
    return _compiled[name]


def _share(df: DataFrame, model: str) -> str:
    """Send the model file to the executors; it is some hundred kilobytes."""
    df.sparkSession.sparkContext.addFile(model)
    return model.rstrip("/").rsplit("/", 1)[-1]


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "token_ids", check_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each text to the columns in keep (by default all but the text).

    A null or empty text has no ids.  Texts are read whole, however long.
    check_col names a column that says whether decoding gives the text back;
    a text that itself holds the space symbol comes back with a space, and one
    that the model's normaliser rewrites doesn't come back.  Each
    row gives one row, so repeated rows stay repeated; ids_col and check_col
    replace columns of the same name, and others may have any name.  An empty
    table gives an empty one.
    """
    from .common import fresh

    name = _share(docs, model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, ids_col, check_col)]
    raw_text = fresh(docs, "raw_text")[0]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias(raw_text))

    def run(batches):
        t = _transducer(name)
        t.forget()  # an earlier task may have been stopped midway
        for b in K.slices(batches, raw_text):
            ids, sizes, same = [], [], []
            for text in b.column(raw_text).to_pylist():
                text = text or ""
                one = t.encode(text)
                ids.append(np.array(one, np.int32))
                sizes.append(len(one))
                if check_col:
                    same.append(t.decode(one) == text.replace(SPACE, " "))
            columns = [b.column(i) for i in range(len(keep))] + [K.list_array(np.concatenate(ids), np.array(sizes))]
            if check_col:
                columns.append(pa.array(same))
            yield pa.RecordBatch.from_arrays(columns, [*keep, ids_col, *[check_col] * bool(check_col)])
        t.forget()

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    if check_col:
        schema = schema.add(check_col, "boolean")
    return rows.mapInArrow(K.tidied(run), schema)


def decode(docs: DataFrame, model: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """Put the text of each id list in text_col; null lists give null."""
    name = _share(docs, model)

    @F.pandas_udf("string")
    def run(ids):
        t = _transducer(name)
        return ids.map(lambda x: None if x is None else t.decode(x))

    return docs.withColumn(text_col, run(F.col(ids_col)))
