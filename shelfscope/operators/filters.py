"""Predicates, ordered reads and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import text as X
from shelfscope.operators.joins import in_work_list


def is_target_brand(brand: Column, targets: list[str], mode: str = "contains", enabled: bool = True) -> Column:
    """Off: every row. Otherwise an empty brand fails; ``exact`` compares folded text, ``contains`` looks
    for any target inside it, literally."""
    if not enabled:
        return F.lit(True)
    wanted = [t.lower().strip() for t in targets]
    hit = F.lower(X.strip(brand)).isin(wanted) if mode == "exact" else X.mentions_any(X.strip(brand), wanted)
    return F.coalesce((brand != "") & hit, F.lit(False))


def keep_target_brands(items: DataFrame, targets: list[str], mode: str = "contains", enabled: bool = True) -> DataFrame:
    return items.where(is_target_brand(F.col("brand"), targets, mode, enabled))


def brand_filter_counts(items: DataFrame, targets: list[str], mode: str = "contains", enabled: bool = True) -> DataFrame:
    hit = is_target_brand(F.col("brand"), targets, mode, enabled)
    return items.agg(F.count_if(hit).alias("kept"), F.count_if(~hit).alias("rejected"))


def is_run_brand(brand: Column, run_brand: str, mode: str = "contains", enabled: bool = True) -> Column:
    """Products are filtered only in a brand run, and then by that brand alone."""
    return is_target_brand(brand, [run_brand], mode) if enabled and run_brand else F.lit(True)


def keep_run_brand(products: DataFrame, run_brand: str, mode: str = "contains", enabled: bool = True) -> DataFrame:
    return products.where(is_run_brand(F.col("brand"), run_brand, mode, enabled))


def with_run_brand(rows: DataFrame, run_brand: str = "") -> DataFrame:
    """A run brand replaces the record's own. Without one, NULL stays NULL and a missing column is ''."""
    if run_brand:
        return rows.withColumn("brand", F.lit(run_brand))
    return rows if "brand" in rows.columns else rows.withColumn("brand", F.lit(""))


def _ordered(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def search_results(df: DataFrame, keyword: str | None = None, limit: int | None = None) -> DataFrame:
    if keyword:
        df = df.where(F.col("search_keyword") == keyword)
    return _ordered(df, [F.asc("search_rank"), F.asc("asin"), F.asc("search_keyword"), F.asc("brand")], limit)


def products(
    df: DataFrame,
    asins: list[str] | DataFrame | None = None,
    brand: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``asins`` may be a short list or, for any number of them, a DataFrame with an ``asin`` column."""
    if isinstance(asins, DataFrame):
        df = in_work_list(df, asins, ["brand"])
    elif asins:
        df = df.where(F.col("asin").isin(asins))
    if brand:
        df = df.where(F.col("brand") == brand)
    return _ordered(df, [F.desc("rating_count"), F.asc("asin"), F.asc("brand")], limit)


def product(df: DataFrame, asin: str) -> DataFrame:
    return products(df, [asin], limit=1)


def reviews(
    df: DataFrame,
    asin: str | None = None,
    brand: str | None = None,
    rating: int | None = None,
    verified_only: bool = False,
    limit: int | None = None,
    order_by_parsed_date: bool = False,
) -> DataFrame:
    """Dates are free text and sort as text unless ``order_by_parsed_date``; 0 means no filter or limit."""
    if asin:
        df = df.where(F.col("asin") == asin)
    if brand:
        df = df.where(F.col("brand") == brand)
    if rating:
        df = df.where(F.col("rating") == rating)
    if verified_only:
        df = df.where(F.col("verified_purchase") == 1)
    when = X.long_date(F.col("date")) if order_by_parsed_date else F.col("date")
    return _ordered(df, [F.desc("helpful_votes"), when.desc(), F.asc("asin"), F.asc("review_id"), F.asc("brand")], limit)


def of_brand(df: DataFrame, brand: str) -> DataFrame:
    return df.where(F.col("brand") == brand)


def distinct_asins(df: DataFrame) -> DataFrame:
    return df.select("asin").distinct()
