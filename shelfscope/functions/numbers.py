"""Numbers written in page text. ANSI casts raise, so every cast of page text is a ``try_cast``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions.text import extract

# How numbers are written on pages.
LEADING_NUMBER = r"^[ \t\n\x0B\f\r]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
COMMA_INTEGER = r"(?U)([\d,]+)"
OUT_OF = r"(?U)([\d.]+)\s*out of"
ANY_NUMBER = r"(?U)([\d.]+)"
BOUGHT = r"(?U)(\d+(?:\.\d+)?)\s*([KkMm])?\s*\+?"
BOUGHT_STRICT = r"(?U)(\d+(?:\.\d+)?)\s*([KkMm](?!\w))?"
PEOPLE = r"(?U)(\d+)\s+people?"
ONE_PERSON = "one person"


def leading_number(text: Column) -> Column:
    """The longest numeric prefix as a double, 0.0 where there is none."""
    return F.coalesce(extract(text, LEADING_NUMBER).try_cast("double"), F.lit(0.0))


def price_value(price: Column) -> Column:
    """``$1,299.00`` to 1299.0 by the prefix rule, so ``$12.99 - $15.99`` counts as 12.99."""
    return leading_number(F.translate(price, "$,", ""))


def comma_integer(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def first_comma_integer(text: Column) -> Column:
    return comma_integer(extract(text, COMMA_INTEGER))


def rating_value(text: Column) -> Column:
    """4.5 from ``4.5 out of 5 stars``."""
    return extract(text, OUT_OF).try_cast("double")


def star_rating(text: Column) -> Column:
    """First number in the text, truncated."""
    return extract(text, ANY_NUMBER).try_cast("double").try_cast("int")


def bought_number(text: Column, strict: bool = False) -> Column:
    """2000 from ``2K+ bought in past month``.

    The plain form keeps two known oddities: ``1,000+`` gives 1, and the m of ``5 more`` is read as a
    million. ``strict`` reads thousands commas and takes K or M only where no letter follows.
    """
    if strict:
        pattern, source = BOUGHT_STRICT, F.replace(text, F.lit(","), F.lit(""))
    else:
        pattern, source = BOUGHT, text
    unit = F.upper(F.regexp_extract(source, pattern, 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)
    return F.coalesce((extract(source, pattern).try_cast("double") * scale).try_cast("bigint"), F.lit(0).cast("bigint"))


def helpful_votes(text: Column) -> Column:
    counted = extract(text, PEOPLE).try_cast("int")
    one = F.when(F.contains(F.lower(text), F.lit(ONE_PERSON)), 1)
    return F.coalesce(counted, one, F.lit(0))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), places)
