"""Tag values: accessors and the numeric reading of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Optional blanks and control characters, a minus, digits with at most one point; the rest is ignored.
NUMBER_PREFIX = r"^[\x00-\x20]*(-?[0-9]*\.?[0-9]*)"
#: Strict decimals, as a whole.
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def number(value: Column) -> Column:
    """The number that a text starts with; null if there is none (never NaN)."""
    return F.regexp_extract(value, NUMBER_PREFIX, 1).try_cast("double")


def string_value(v: Column) -> Column:
    return F.coalesce(v, F.lit(""))


def long_value(v: Column) -> Column:
    """Truncated; 0 if absent or not a number."""
    return F.coalesce(number(v).cast("long"), F.lit(0).cast("long"))


def int_value(v: Column) -> Column:
    return F.coalesce(number(v).try_cast("int"), F.lit(0))


def double_value(v: Column) -> Column:
    return F.coalesce(number(v), F.lit(0.0))


def boolean_value(v: Column) -> Column:
    return F.coalesce(v != "no", F.lit(False))


def has_tag(v: Column, value: str | None = None) -> Column:
    """Present (even with the value ``no``); with ``value``: equal to it, an absent tag counting as an empty text."""
    return v.isNotNull() if value is None else string_value(v) == value


def is_decimal(v: Column, strict: bool = True) -> Column:
    return F.coalesce(v.rlike(DECIMAL), F.lit(False)) if strict else number(v).isNotNull()


def decimal_text(v: Column) -> Column:
    """A strict decimal without zeros at its end, and without a point if nothing follows it; null for other texts."""
    short = F.regexp_replace(F.regexp_replace(v, r"(\.[0-9]*[1-9])0+$", "$1"), r"\.0+$", "")
    return F.when(is_decimal(v), F.when(short == "-0", F.lit("0")).otherwise(short))


def tag_count(tags: Column) -> Column:
    return F.size(tags)


def tag_text(tags: Column) -> Column:
    """``k=v, k=v`` in order of keys."""
    pairs = F.array_sort(F.map_entries(tags))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e.key, F.lit("="), e.value)), ", ")
