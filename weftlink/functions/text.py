"""Text normalisation as column expressions.

Everything is a built-in expression but ``strip_marks_any``, the Arrow function
for characters that decompose into several.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Everything between words; unlike ``\w``, the same in Java and Python for all scripts.
GAP = r"[^\p{L}\p{N}_]+"

# Legal forms, written out for canonical names, in the order of their use.
EXPANSIONS = (
    (r"\bpvt[\.\s]?ltd\b", "private limited"),
    (r"\bltd\b", "limited"),
    (r"\bcorp\b", "corporation"),
    (r"\binc\b", "incorporated"),
    (r"\bco\b", "company"),
)

# Legal forms, shortened for name keys, in the order of their use.
CONTRACTIONS = (
    (r"\bprivate\s+limited\b", "pvt ltd"),
    (r"\bpvt[\.\s]?ltd\b", "pvt ltd"),
    (r"\bcorporation\b", "corp"),
    (r"\bincorporated\b", "inc"),
    (r"\bcompany\b", "co"),
    (r"\bsociete\s+anonyme\b", "sa"),
    (r"\bsasu?\b", "sas"),
)

# French legal forms whose letters may stand apart, longer ones before those they begin with.
FRENCH_FORMS = ("sarl", "sasu", "sas", "sa", "sci", "eurl", "snc", "gie", "eirl")

# French street words.
FRENCH_STREETS = (
    ("bd", "boulevard"),
    ("av", "avenue"),
    ("imp", "impasse"),
    ("all", "allee"),
    ("che", "chemin"),
    ("pl", "place"),
    ("rte", "route"),
    ("zi", "zone industrielle"),
    ("za", "zone artisanale"),
)


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(1)
def _tables() -> tuple[str, str, str]:
    """Characters with one bare form, those forms followed by nothing for marks, and a class of those with several."""
    single, bare, dropped, several = [], [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or (b := _bare(c)) == c:
            continue
        if len(b) == 1:
            single.append(c)
            bare.append(b)
        else:
            (several if b else dropped).append(c)
    ranges, last = [], None
    for c in several:
        if last is not None and ord(c) == last + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
        last = ord(c)
    odd = "".join(f"\\u{ord(a):04X}-\\u{ord(b):04X}" for a, b in ranges) + "\\x{10000}-\\x{%X}" % sys.maxunicode
    return "".join(single + dropped), "".join(bare), f"[{odd}]"


@F.pandas_udf(StringType())
def strip_marks_any(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for any text."""
    return texts.map(lambda t: None if t is None else _bare(t))


def strip_marks(c: Column, native: bool = False) -> Column:
    """Compatibility decomposition without combining marks.

    Native, one character gives one at most, which covers accented letters and
    keeps Python out of the plan.  Otherwise texts with ligatures, fractions, Hangul and the like go through
    Python; the others are sent there as nulls.
    """
    source, target, several = _tables()
    simple = F.translate(c, source, target)
    if native:
        return simple
    odd = c.rlike(several)
    return F.when(odd, strip_marks_any(F.when(odd, c))).otherwise(simple)


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def replace_all(c: Column, rules) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_text(c: Column, native: bool = False) -> Column:
    """Bare lower-case words with single spaces; null and blank texts give an empty one."""
    low = F.lower(strip_marks(F.coalesce(c, F.lit("")), native))
    return F.btrim(F.regexp_replace(low, GAP, " "))


def canonical_name(c: Column, native: bool = False) -> Column:
    return squeeze(replace_all(clean_text(c, native), EXPANSIONS))


def postal_code(address: Column) -> Column:
    """The first number of five or six digits, null if there is none."""
    return F.nullif(F.regexp_extract(address, r"\b(\d{5,6})\b", 1), F.lit(""))


def phonetic_prefix(cleaned: Column, length: int = 4) -> Column:
    """The first Latin letters, padded with x."""
    return F.rpad(F.substring(F.regexp_replace(cleaned, "[^a-z]", ""), 1, length), length, "x")


def name_key(c: Column, native: bool = False) -> Column:
    """All letters and digits of the shortened name, run together."""
    low = F.lower(strip_marks(F.coalesce(c, F.lit("")), native))
    return F.regexp_replace(replace_all(low, CONTRACTIONS), GAP, "")


def french_text(c: Column, native: bool = False) -> Column:
    """As clean_text(), with elided articles kept as words."""
    low = F.translate(F.lower(strip_marks(F.coalesce(c, F.lit("")), native)), "’`", "''")
    return F.btrim(F.regexp_replace(F.regexp_replace(low, r"\b([dl])'", "$1 "), GAP, " "))


def french_name(c: Column, native: bool = False) -> Column:
    rules = [(r"\b" + r"[\.\s]?".join(form) + r"\b", form) for form in FRENCH_FORMS]
    return squeeze(replace_all(french_text(c, native), rules))


def french_address(c: Column, native: bool = False) -> Column:
    """struct(address, postal, department); a null address reads ``none``."""
    raw = F.coalesce(c, F.lit("None"))
    code = r"\b(\d{2})(\d{3})\b"
    streets = [(rf"\b{short}\b", long) for short, long in FRENCH_STREETS]
    return F.struct(
        replace_all(french_text(raw, native), streets).alias("address"),
        F.nullif(F.regexp_extract(raw, code, 0), F.lit("")).alias("postal"),
        F.nullif(F.regexp_extract(raw, code, 1), F.lit("")).alias("department"),
    )


def tokens(cleaned: Column) -> Column:
    """The words of a cleaned text; none for an empty one."""
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def salient_tokens(cleaned: Column, first: int, least: int = 4) -> Column:
    """Of the first words those with ``least`` characters or more, repeated ones included."""
    return F.filter(F.slice(tokens(cleaned), 1, first), lambda t: F.char_length(t) >= least)


def sorted_tokens(cleaned: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens(cleaned))), " ")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The distinct n-grams; none for shorter texts."""
    return F.when(F.char_length(c) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))))


def char_trigram_codes(c: Column) -> Column:
    """The distinct 3-grams of char_ngrams() as numbers, 21 bits for each character's code point."""
    code = lambda i: F.ascii(F.substring(c, i, F.lit(1))).cast("long")
    run = lambda i: F.shiftleft(code(i), 42).bitwiseOR(F.shiftleft(code(i + 1), 21)).bitwiseOR(code(i + 2))
    return F.when(F.char_length(c) < 3, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - 2), run)))


def word_count(c: Column) -> Column:
    inner = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, " ")))


def digit_count(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.regexp_replace(c, r"\p{Nd}", ""))


def list_items(c: Column) -> Column:
    """The trimmed, non-empty items of a comma-joined list; a null list is empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")


def list_size(c: Column) -> Column:
    """How many pieces a comma-joined list has, empty ones included; 0 for a blank one."""
    return F.when(F.btrim(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(c, ",")))


def source_of(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit("-"), F.lit(1))


def spec_clean(text: str | None) -> str:
    """clean_text() in plain Python, for tests."""
    return " ".join(re.sub(r"[^\w]", " ", _bare(text or "").lower()).split())
