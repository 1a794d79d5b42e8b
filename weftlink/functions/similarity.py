"""Similarities of two texts as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .text import char_ngrams, sorted_tokens, tokens


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Of n-gram sets; where a text is shorter than n, whether both are equal."""
    short = (F.char_length(a) < n) | (F.char_length(b) < n)
    return F.when(short, (a == b).cast("double")).otherwise(set_jaccard(char_ngrams(a, n), char_ngrams(b, n)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return levenshtein_ratio(sorted_tokens(a), sorted_tokens(b))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.least(F.char_length(a), F.char_length(b)) / longest)


def jaro_winkler_of(a: str, b: str, boost: float = 0.1) -> float:
    """Jaro similarity with a boost for up to four equal first characters.

    The boost holds at any similarity, and half a transposition counts.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, t in zip(b, taken, strict=True) if t]
    m, moved = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * boost * (1 - jaro)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row a text, filled up with zeros, and the texts' lengths."""
    length = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, int(length.max(initial=0)))), np.uint32)
    inside = np.arange(out.shape[1]) < length[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, length


def jaro_winkler_many(a: list[str], b: list[str], boost: float = 0.1) -> np.ndarray:
    """jaro_winkler_of() for many pairs at once: a step for each character of the longest left text."""
    x, n = codes_of(a)
    y, m = codes_of(b)
    rows, place = np.arange(len(a)), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    taken, hit = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        fits = (y == x[:, i, None]) & ~taken & (np.abs(place - i) <= reach[:, None]) & (place < m[:, None]) & (i < n)[:, None]
        first = fits.argmax(1)
        found = fits[rows, first]
        taken[rows[found], first[found]] = True
        hit[:, i] = found
    k = hit.sum(1)
    differ = np.bincount(np.nonzero(hit)[0], x[hit] != y[taken], len(a))  # both sides list a row's hits in order
    with np.errstate(all="ignore"):
        jaro = np.where(k > 0, (k / n + k / m + (k - differ / 2) / k) / 3, 0.0)
    w = min(4, x.shape[1], y.shape[1])
    inside = np.arange(w) < np.minimum(n, m)[:, None]
    same = np.logical_and.accumulate((x[:, :w] == y[:, :w]) & inside, 1).sum(1)
    out = jaro + same * boost * (1 - jaro)
    out[(n == m) & (k == n) & (differ == 0)] = 1.0
    return np.where((n == 0) & (m == 0), 1.0, out)


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=a.index, dtype="float64")
    given = a.notna() & b.notna()
    pairs = pd.DataFrame({"a": a[given], "b": b[given]})
    distinct = pairs.drop_duplicates().assign(n=lambda p: p["a"].str.len(), m=lambda p: p["b"].str.len()).sort_values(["m", "n"])
    found, at = {}, 0
    while at < len(distinct):  # pieces of like lengths and a bounded number of cells
        step = max(1, (1 << 20) // (1 + int(distinct["m"].iloc[at : at + 4096].max())))
        part = distinct.iloc[at : at + min(step, 4096)]
        x, y = part["a"].tolist(), part["b"].tolist()
        found |= dict(zip(zip(x, y, strict=True), jaro_winkler_many(x, y).tolist(), strict=True))
        at += len(part)
    if len(pairs):
        out[given] = [found[p] for p in zip(pairs["a"], pairs["b"], strict=True)]
    return out.where(given, None)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Equal texts are settled without Python; repeated pairs are computed once a batch."""
    same = a == b
    return F.when(same, F.lit(1.0)).otherwise(_jaro_winkler(F.when(~same, a), F.when(~same, b)))


def soundex_key(c: Column) -> Column:
    return F.soundex(c)


def common_prefix(a: Column, b: Column) -> Column:
    """The number of equal first characters."""
    n = F.least(F.char_length(a), F.char_length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).when(F.size(differs) == 0, n).otherwise(differs[0] - 1)


def common_suffix(a: Column, b: Column) -> Column:
    """The number of equal last characters."""
    return common_prefix(F.reverse(a), F.reverse(b))


def word_ngram_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """Of the sets of n words in a row; 0 if either text has fewer."""

    def grams(c: Column) -> Column:
        words = tokens(c)
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return set_jaccard(grams(a), grams(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the shared words and the shared words with either side's own."""
    x, y = F.array_sort(F.array_distinct(tokens(a))), F.array_sort(F.array_distinct(tokens(b)))
    both = F.array_intersect(x, y)
    shared = F.array_join(both, " ")
    left = F.btrim(F.concat_ws(" ", shared, F.array_join(F.array_except(x, y), " ")))
    right = F.btrim(F.concat_ws(" ", shared, F.array_join(F.array_except(y, x), " ")))
    return F.when(F.size(both) == 0, levenshtein_ratio(left, right)).otherwise(F.greatest(levenshtein_ratio(shared, left), levenshtein_ratio(shared, right), levenshtein_ratio(left, right)))


def damerau_of(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours is one step and nothing is edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau_of(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def monge_elkan_of(a: str, b: str) -> float:
    """The mean over a's words of the best Jaro-Winkler similarity with one of b's."""
    x, y = a.split(), b.split()
    if not x or not y:
        return float(not x and not y)
    return sum(max(jaro_winkler_of(s, t) for t in y) for s in x) / len(x)


@F.pandas_udf(DoubleType())
def monge_elkan(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else monge_elkan_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# Words that tell branches of one firm apart.
DIRECTIONS = ("north", "south", "east", "west", "central")


def directions_differ(a: Column, b: Column) -> Column:
    """Whether both texts name directions, and not the same ones."""
    named = lambda c: F.array_sort(F.array_intersect(tokens(c), F.array(*map(F.lit, DIRECTIONS))))
    x, y = named(a), named(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def must_stay_apart(name_a: Column, name_b: Column, addr_a: Column, addr_b: Column, least: float = 0.5) -> Column:
    """Same address but unlike names, or different branches: a reason against merging."""
    return ((addr_a == addr_b) & (addr_a != "") & (levenshtein_ratio(name_a, name_b) < least)) | directions_differ(name_a, name_b)
