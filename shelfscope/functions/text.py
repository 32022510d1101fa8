"""Text, date, JSON and collection column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s, \d and \w are ASCII unless (?U) is given; page text need not be.
_SPACE = r"[\s\x1c-\x1f]"

# What surrounds a brand name, and how dates and times are written.
BRAND_LEAD = rf"(?iU)^(?:Visit the|Brand:?){_SPACE}*"
BRAND_TAIL = rf"(?iU){_SPACE}*Store$"
AVAILABLE_DATE = r"(?U)(\w+\s+\d+,?\s*\d{4})"
REVIEW_DATE = r"(?Ud)on\s+(.+)$"
LONG_DATE = "MMMM d, yyyy"
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; NULL, not '', where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the blanks ``trim`` takes."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_brand(text: Column) -> Column:
    lead = F.regexp_replace(text, BRAND_LEAD, "")
    return strip(F.regexp_replace(lead, BRAND_TAIL, ""))


def keyword_to_url(keyword: Column) -> Column:
    return F.replace(keyword, F.lit(" "), F.lit("+"))


def keyword_from_url(text: Column) -> Column:
    """The decoded keyword; text that is no valid encoding ("50%off") stands for itself."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def content_hash(text: Column, chars: int = 100, digits: int = 12) -> Column:
    return F.substring(F.md5(F.encode(F.substring(text, 1, chars), "UTF-8")), 1, digits)


def mentions(text: Column, phrase: str) -> Column:
    """Case-insensitive literal substring test."""
    return F.contains(F.lower(text), F.lit(phrase.lower()))


def mentions_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase, taken literally and without case, occurs: one scan of the text for all of them."""
    if not phrases:
        return F.lit(False)
    return F.rlike(F.lower(text), F.lit("|".join(re.escape(p.lower()) for p in phrases)))


def available_date(text: Column) -> Column:
    """``Month d, yyyy`` inside a product-details row."""
    return extract(text, AVAILABLE_DATE)


def review_date(text: Column) -> Column:
    """What follows the first ``on``, else the text itself."""
    return F.coalesce(extract(text, REVIEW_DATE), text)


def long_date(text: Column) -> Column:
    """Typed form of ``March 5, 2024``; NULL for any other shape."""
    return F.to_date(F.try_to_timestamp(text, F.lit(LONG_DATE)))


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), ISO_TIME)


def encode_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def decode_json_array(text: Column, element: str) -> Column:
    """Stored JSON text to an array; broken or missing text gives an empty one."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.from_json(F.lit("[]"), f"array<{element}>"))


def first_present(values: Column) -> Column:
    """First non-NULL element."""
    return F.get(F.array_compact(values), F.lit(0))


def first_where(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def first_text(values: Column) -> Column:
    """First element that is neither NULL nor empty."""
    return first_where(values, lambda v: v != "")


def lookup(mapping: Column, key: str, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(default))


def flag(value: Column) -> Column:
    """0/1 from a truth value; NULL counts as false."""
    return F.coalesce(value, F.lit(False)).cast("int")
