"""Keep one row per key.

All of these are ``row_number() = 1`` filters: Spark plans them with a map-side ``WindowGroupLimit``, so
a task sends at most one row per key and a key that holds a third of the data costs no more than any other.
The order columns must tell rows of one key apart. The input is read once, so it may be a fresh extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


#: Rows without a key get a number of their own here; a second pass over the input for them would run what it comes from twice.
_APART = "_apart"


def _keyless_apart(df: DataFrame, keys: list[str]) -> DataFrame:
    keyless = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(key).isNull()
    return df.withColumn(_APART, F.when(keyless, F.monotonically_increasing_id()))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _one_per(df, keys, [F.col(c).asc_nulls_first() for c in order])


def last_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _one_per(df, keys, [F.col(c).desc_nulls_last() for c in order])


def last_per_unique_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``last_per`` under SQL's UNIQUE rule: a NULL in the key equals nothing, so such rows all stay."""
    return last_per(_keyless_apart(df, keys), [*keys, _APART], order).drop(_APART)


def first_listing_per_keyword(items: DataFrame, order: tuple[str, ...] = ("page_no", "pos")) -> DataFrame:
    return first_per(items, ["search_keyword", "asin"], list(order))


def first_listing(items: DataFrame, order: tuple[str, ...] = ("keyword_ord", "page_no", "pos")) -> DataFrame:
    """First listing over all keywords; equals deduplicating each keyword first and then across them."""
    return first_per(items, ["asin"], list(order))


def first_review(reviews: DataFrame, order: tuple[str, ...] = ("page_no", "pos")) -> DataFrame:
    return first_per(reviews, ["asin", "review_id"], list(order))


def newest_page(pages: DataFrame, keys: list[str], bad: str | None = None) -> DataFrame:
    """One copy per page position, the latest fetched; a copy that is ``bad`` only where there is no other.

    Pages without a key are told apart by nothing and all stay.
    """
    order = [F.col(c).desc_nulls_last() for c in ("fetched_at", "page_id")]
    apart = _keyless_apart(pages, keys)
    return _one_per(apart, [*keys, _APART], [F.col(bad).asc(), *order] if bad else order).drop(_APART)
