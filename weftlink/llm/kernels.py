"""Array kernels over the bytes of many texts at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte value, and odd bases for two independent hashes.
BYTE = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * U64(2) + _rng.integers(0, 2, (2, 256), dtype=np.uint64)
BASES = tuple(int(x) | 1 for x in _rng.integers(1 << 60, 1 << 63, 2))
_powers: dict[int, tuple[np.ndarray, np.uint64]] = {}


def tidy() -> None:
    """Give memory back to the system: Python workers live on between tasks, and their freed memory would count."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that tidies up when its partition is done."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        at = edges(b.column(b.schema.get_field_index(text)))
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield b.slice(first, last - first)
            first = last


def edges(column: pa.Array) -> np.ndarray:
    """The byte offsets of the rows' texts, one more than there are rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the rows' texts, one after the other, and the rows' edges in them.  Nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at, data = edges(column), column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    return _mix(np.array(h, U64))


def _mix(h: np.ndarray) -> np.ndarray:
    """mixed() in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.uint64]:
    """base**i modulo 2**64 for i up to n, and the inverse of the last of these powers."""
    held = _powers.get(which)
    if held is None or len(held[0]) <= n:
        up = np.empty(max(n + 1, 1 << 16), U64)
        up[0], done = 1, 1
        while done < len(up):
            step = min(done, len(up) - done)
            np.multiply(up[:step], U64(pow(BASES[which], done, 1 << 64)), out=up[done : done + step])
            done += step
        held = _powers[which] = up, U64(pow(BASES[which], -(len(up) - 1), 1 << 64))
    return held


def _moved(h: np.ndarray, start: np.ndarray | slice, which: int, n: int) -> np.ndarray:
    """h * base**-start in place, by powers that count from the last one down: no second table."""
    up, last = powers(n, which)
    h *= up[::-1][start]
    h *= last
    return h


#: Places that are hashed at once: what is made on the way stays in the CPU's cache.
PART = 1 << 16


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums from which spans() gives the rolling hash of any span; one more than there are values."""
    return _summed(len(values), lambda a, b: values[a:b], which)


def byte_sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """prefix_sums() of the bytes' random values, which are never all held."""
    return _summed(len(raw), lambda a, b: BYTE[which][raw[a:b]], which)


def _summed(n: int, values: Callable, which: int) -> np.ndarray:
    up, out = powers(n, which)[0], np.empty(n + 1, U64)
    out[0] = 0
    for a in range(0, n, PART):
        b = min(a + PART, n)
        np.cumsum(values(a, b) * up[a:b], dtype=U64, out=out[a + 1 : b + 1])
        out[a + 1 : b + 1] += out[a]
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of values[start:end] for each pair; equal spans have equal hashes wherever they stand."""
    h = sums[end]
    h -= sums[start]
    return _mix(_moved(h, start, which, len(sums)))


def rolling(sums: np.ndarray, width: int, which: int = 0, first: int = 0, last: int | None = None) -> np.ndarray:
    """spans() of all spans of one width, or of those that start from first to before last."""
    last = len(sums) - width if last is None else last
    h = sums[first + width : last + width] - sums[first:last]
    return _mix(_moved(h, slice(first, last), which, len(sums)))


def rolling_zeros(sums: np.ndarray, width: int, modulus: int, which: int = 0) -> np.ndarray:
    """Where the spans of one width have a hash that the modulus divides."""
    n = max(0, len(sums) - width)
    parts = [np.flatnonzero(rolling(sums, width, which, a, min(a + PART, n)) % U64(modulus) == 0) + a for a in range(0, n, PART)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


IS_BREAK = np.zeros(256, bool)
IS_BREAK[[32, *range(9, 14)]] = True


def words(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray = IS_BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in the bytes, and the edges of the rows in the list of words."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~breaks[raw]
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    cut = at[1:-1]  # rows follow each other with nothing between: a row's edge also ends a word
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))])
    both = cut[inside[cut] & inside[cut + 1]]
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if len(both):
        start, end = np.sort(np.concatenate([start, both])), np.sort(np.concatenate([end, both]))
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return spans(byte_sums(raw, which), start, end, which)


def row_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The sum of values[first:last] for each pair of ascending, disjoint spans."""
    out, some = np.zeros(len(first)), last > first
    if some.any():
        pairs = np.stack([first[some], last[some]], 1).ravel()
        padded = np.append(values, 0)
        out[some] = np.add.reduceat(padded, pairs)[::2]
    return out


def distinct_by_row(row: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs and their counts; key needs ``bits`` bits."""
    both, n = np.unique((row.astype(U64) << U64(bits)) | key.astype(U64), return_counts=True)
    return (both >> U64(bits)).astype(np.int64), (both & U64((1 << bits) - 1)).astype(np.int64), n


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
