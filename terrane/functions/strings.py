"""Text helpers as columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that become two, or that don't come apart into a letter and marks.
LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th"}


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without, one for one."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c not in LETTERS and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    """Latin letters without their marks; some others as two letters; combining marks go."""
    out = F.translate(text, *_plain_letters())
    for a, b in LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\p{Mn}+", "")


def key_of(text: Column) -> Column:
    """A key: lower-case ASCII letters, digits and single hyphens between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(without_accents(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def is_ascii(text: Column) -> Column:
    return F.coalesce(F.char_length(text) == F.octet_length(text), F.lit(False))


def escaped(text: Column) -> Column:
    """Special characters after a backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (("\b", "\\b"), ("\n", "\\n"), ("\t", "\\t"), ("\f", "\\f"), ("\r", "\\r"), ('"', '\\"'), ("'", "\\'"), ("\0", "\\0")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_escaped(text: Column) -> Column:
    """What stands between the quotes of the text as JSON."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(3), F.char_length(whole) - 4))


def cleaned(text: Column) -> Column:
    """Control characters as spaces."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.char_length(text)))


def count_of(text: Column, char: str) -> Column:
    """How often a character occurs."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def longest_common(a: str, b: str) -> int:
    """The length of the longest text that occurs in both."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[k] + 1 if x == y else 0 for k, y in enumerate(b))]
        best = max(best, *row)
    return best


def longest_common_of(a: Column, b: Column) -> Column:
    """``longest_common`` of two columns; null if either is."""

    @F.pandas_udf("int")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else longest_common(x, y) for x, y in zip(left, right)], dtype="Int32")

    return run(a, b)
