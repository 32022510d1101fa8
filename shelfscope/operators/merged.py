"""Search listings joined with product details and review counts, and the work-planning set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.joins import HOT_ROWS, hot_keys, salted_join
from shelfscope.operators.ranking import top_for_review
from shelfscope.session import stage

FROM_SEARCH = ["asin", "search_keyword", "search_rank", "is_sponsored", "is_amazon_choice", "is_best_seller"]
FROM_PRODUCT = [
    "title", "brand", "price", "rating", "rating_count", "bsr_rank", "bsr_category", "is_fba", "has_aplus", "seller",
    "first_available",
]

# The columns after the rank only spread its ties over the ranges of a distributed sort.
MERGED_ORDER = ["search_rank", "asin", "search_keyword", "brand"]


def review_counts(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Reviews per asin, counted before any join."""
    if brand:
        reviews = reviews.where(F.col("brand") == brand)
    return reviews.groupBy("asin").agg(F.count("*").alias("review_count"))


def merged_per_brand(search: DataFrame, products: DataFrame, reviews: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """The merged rows of all brands at once, under ``search_brand``: those that ``merged_view`` gives for each brand in turn."""
    listings = search.select(*FROM_SEARCH, F.col("brand").alias("search_brand"))
    counts = reviews.groupBy("asin", F.col("brand").alias("search_brand")).agg(F.count("*").alias("review_count"))
    cut = {"hot": stage(hot_keys(listings.select("asin"), ["asin"], min_rows)), "spread_by": ["search_keyword", "search_brand", "search_rank"]}
    rows = salted_join(listings, products.select("asin", *FROM_PRODUCT), "asin", "left", **cut)
    rows = salted_join(rows, counts, ["asin", "search_brand"], "left", **cut)
    return rows.select("search_brand", *FROM_SEARCH, *FROM_PRODUCT, F.coalesce("review_count", F.lit(0)).alias("review_count"))


def merged_view(
    search: DataFrame,
    products: DataFrame,
    reviews: DataFrame,
    brand: str | None = None,
    match_brand: bool = False,
    ordered: bool = True,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every search row with each stored product of its asin and the asin's review count.

    Products and counts are put together first, so the large search side is shuffled once. The join is on
    asin alone, so an asin stored under several brands gives several rows; ``match_brand`` keeps only the
    product of the listing's own brand.
    """
    if brand:
        search = search.where(F.col("brand") == brand)
    listings = search.select(*FROM_SEARCH, F.col("brand").alias("search_brand"))
    counts = review_counts(reviews, brand)
    details = products.select("asin", *FROM_PRODUCT)
    # Listings are the side where an asin can be hot: its rows are counted once for all joins. Products are one row per asin and
    # brand and counts one per asin, so these meet in a plain join.
    cut = {"hot": stage(hot_keys(listings.select("asin"), ["asin"], min_rows)), "spread_by": ["search_keyword", "search_brand", "search_rank"]}
    if match_brand:
        own = details.withColumn("search_brand", F.col("brand"))
        rows = salted_join(listings, own, ["asin", "search_brand"], "left", **cut)
        rows = salted_join(rows, counts, "asin", "left", **cut)
    else:
        rows = salted_join(listings, details.join(counts, "asin", "full_outer"), "asin", "left", **cut)
    out = rows.select(*FROM_SEARCH, *FROM_PRODUCT, F.coalesce("review_count", F.lit(0)).alias("review_count"))
    return out.orderBy(*MERGED_ORDER) if ordered else out


def pending_products(search: DataFrame, products: DataFrame, brand: str | None = None) -> DataFrame:
    """Listed asins without a stored product."""
    if brand:
        search = search.where(F.col("brand") == brand)
    return search.select("asin").distinct().join(products.select("asin"), "asin", "left_anti")


def heavily_reviewed(reviews: DataFrame, min_reviews: int = 100) -> DataFrame:
    """Asins with more than ``min_reviews`` stored reviews."""
    counts = reviews.groupBy("asin").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > min_reviews).select("asin")


def resume_reviews(asins: DataFrame, reviews: DataFrame, min_reviews: int = 100) -> DataFrame:
    """Drop asins whose reviews are already stored; other columns, such as a rank, are kept."""
    return asins.join(heavily_reviewed(reviews, min_reviews), "asin", "left_anti")


def pending_reviews(products: DataFrame, reviews: DataFrame, top_n: int = 50, min_reviews: int = 100) -> DataFrame:
    return resume_reviews(top_for_review(products, top_n), reviews, min_reviews)
