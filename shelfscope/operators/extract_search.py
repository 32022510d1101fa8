"""Search pages to listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import numbers as N
from shelfscope.functions import text as X
from shelfscope.sources.candidates import item_faults, read_candidates

# Fixed values.
ITEMS_PER_PAGE = 48
ASIN_LENGTH = 10
NOT_A_BRAND = [
    "price", "product page", "free shipping", "delivery", "prime", "subscribe", "save", "deal", "offer", "coupon",
    "promotion", "best seller", "amazon's choice", "sponsored", "ad",
]
CHOICE_BADGE = "Amazon's Choice"
BEST_SELLER_BADGE = "Best Seller"
MONEY_SIGN = r"[$€£]"
DECIMAL_PRICE = r"(?U)\d+\.\d{2}"
RATING_COUNT = r"(?U)([\d,]+)\s*rating"
SPONSORED = "sponsored"
PRODUCT_URL = "https://www.amazon.com/dp/"


def valid_brand(text: Column, stop_words: list[str] = NOT_A_BRAND) -> Column:
    """A brand text holds no stop word (as a substring, so "Adidas" falls to "ad"), price or currency sign."""
    ok = (
        (text != "")
        & ~X.mentions_any(text, stop_words)
        & ~F.rlike(text, F.lit(MONEY_SIGN))
        & ~F.rlike(text, F.lit(DECIMAL_PRICE))
        & (F.length(text) <= 60)
    )
    return F.coalesce(ok, F.lit(False))


def _title(item: Column) -> Column:
    spans = F.array_join(F.filter(item.heading_spans, lambda t: t != ""), " ")
    return F.coalesce(
        X.first_where(item.title, lambda t: F.length(t) > 15),
        F.when(F.length(spans) > 15, spans),
        item.heading,
        item.link_label,
        F.lit(""),
    )


def _rating(item: Column) -> Column:
    return F.coalesce(X.first_present(F.transform(item.rating, N.rating_value)), N.rating_value(item.star_label))


def _rating_count(item: Column) -> Column:
    plain = F.transform(item.counts, lambda t: F.translate(t, ",()", ""))
    shown = X.first_where(plain, lambda t: F.rlike(t, F.lit("^[0-9]+$"))).try_cast("bigint")
    return F.coalesce(shown, N.comma_integer(X.extract(item.count_label, RATING_COUNT)))


def _badge(item: Column, badge: str) -> Column:
    return X.flag(F.exists(item.badges, lambda t: X.mentions(t, badge)))


def _brand(item: Column, rule: str, stop_words: list[str]) -> Column:
    if rule == "v1":
        chosen = X.first_where(item.brand_v1, lambda t: (t != "") & (F.length(t) < 50))
    else:
        chosen = X.first_where(item.brand, lambda t: valid_brand(t, stop_words))
    return X.clean_brand(F.coalesce(chosen, F.lit("")))


def search_candidates(pages: DataFrame) -> DataFrame:
    """One row per page: its columns, ``has_next``, the candidate items and their faults.

    An unreadable page has no items and does not end its keyword; an unreadable item is NULL in its place.
    """
    return read_candidates(pages, "search").select(
        "*", F.coalesce("found.has_next", F.lit(True)).alias("has_next"), F.col("found.items").alias("items"), item_faults().alias("faults")
    ).drop("found")


def search_items(
    candidates: DataFrame, brand_rule: str = "v2", stop_words: list[str] = NOT_A_BRAND, keep_faults: bool = False
) -> DataFrame:
    """Listing rows of candidate pages (``keyword``, ``page_no``, ``items``); other page columns are kept.

    With ``keep_faults`` a page's first row also holds its ``faults``, and a row without an item stands for a page that has nothing else.
    """
    carried = [c for c in candidates.columns if c not in ("items", "has_next", "asin", "keyword", "brand", "url", "faults")]
    item, wanted, told = F.col("item"), F.length("item.asin") == ASIN_LENGTH, []
    if keep_faults:
        placed = candidates.select(*carried, "keyword", "faults", F.posexplode_outer("items").alias("pos", "item"))
        told = [F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("faults")).alias("faults")]
        wanted = wanted | ((F.coalesce("pos", F.lit(0)) == 0) & (F.size("faults") > 0))
    else:
        placed = candidates.select(*carried, "keyword", F.posexplode("items").alias("pos", "item"))
    return placed.where(wanted).select(
        *carried,
        *told,
        "pos",
        item.asin.alias("asin"),
        F.col("keyword").alias("search_keyword"),
        ((F.col("page_no") - 1).cast("bigint") * ITEMS_PER_PAGE + F.col("pos") + 1).alias("search_rank"),
        _title(item).alias("title"),
        _brand(item, brand_rule, stop_words).alias("brand"),
        F.coalesce(X.first_where(item.price, lambda t: F.contains(t, F.lit("$"))), F.lit("")).alias("price"),
        F.coalesce(X.first_present(item.original_price), F.lit("")).alias("original_price"),
        _rating(item).alias("rating"),
        _rating_count(item).alias("rating_count"),
        X.flag(item.ad_badge | F.exists(item.ad_spans, lambda t: F.lower(t) == SPONSORED)).alias("is_sponsored"),
        _badge(item, CHOICE_BADGE).alias("is_amazon_choice"),
        _badge(item, BEST_SELLER_BADGE).alias("is_best_seller"),
        F.concat(F.lit(PRODUCT_URL), item.asin).alias("url"),
        F.coalesce(item.image, F.lit("")).alias("image_url"),
    )
