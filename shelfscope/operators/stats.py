"""Brand, price and review statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numbers import percent, price_value

# Upper bounds of the price buckets.
PRICE_BUCKETS = [(20, "0-20"), (50, "20-50"), (100, "50-100"), (200, "100-200")]
PRICE_REST = "200+"


def brand_stats(products: DataFrame, limit: int | None = 50, brand: str | None = None) -> DataFrame:
    """Per-brand figures, most products first. A brand filter applies before the limit."""
    named = products.where((F.col("brand") != "") & (F.lit(True) if brand is None else F.col("brand") == brand))
    out = (
        named.groupBy("brand")
        .agg(
            F.count("*").alias("product_count"),
            F.avg("rating").alias("avg_rating"),
            F.sum("rating_count").alias("total_reviews"),
            F.avg("bsr_rank").alias("avg_bsr"),
        )
        .orderBy(F.desc("product_count"), "brand")
    )
    return out.limit(limit) if limit else out


def price_bucket(price: Column) -> Column:
    value, bucket = price_value(price), F.lit(PRICE_REST)
    for bound, name in reversed(PRICE_BUCKETS):
        bucket = F.when(value < bound, name).otherwise(bucket)
    return bucket


def price_distribution(products: DataFrame) -> DataFrame:
    order = F.lit(len(PRICE_BUCKETS))
    for at, (_, name) in enumerate(PRICE_BUCKETS):
        order = F.when(F.col("price_range") == name, at).otherwise(order)
    priced = products.where(F.col("price") != "").select(price_bucket(F.col("price")).alias("price_range"))
    return priced.groupBy("price_range").agg(F.count("*").alias("count")).orderBy(order)


def _review_figures() -> list[Column]:
    rating = F.col("rating")
    return [
        F.count("*").alias("total"),
        F.avg("rating").alias("avg_rating"),
        F.sum(F.when(F.col("verified_purchase") == 1, 1).otherwise(0)).alias("verified_count"),
        F.sum(F.when(rating >= 4, 1).otherwise(0)).alias("positive_count"),
        F.sum(F.when(rating <= 2, 1).otherwise(0)).alias("negative_count"),
    ]


def review_stats(reviews: DataFrame, asin: str | None = None) -> DataFrame:
    if asin:
        reviews = reviews.where(F.col("asin") == asin)
    return reviews.agg(*_review_figures())


def review_stats_by_asin(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("asin").agg(*_review_figures())


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def brand_progress(search: DataFrame, products: DataFrame, reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Stored rows per brand and table; one row, zeros included, when a brand is named."""
    parts = {"search_results": search, "products": products, "reviews": reviews}
    long = None
    for name, df in parts.items():
        rows = df if brand is None else df.where(F.col("brand") == brand)
        one = rows.groupBy("brand").agg(F.count("*").alias("n")).select("brand", F.lit(name).alias("part"), "n")
        long = one if long is None else long.unionByName(one)
    figures = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p) for p in parts]
    if brand is None:
        return long.groupBy("brand").agg(*figures)
    return long.agg(*figures).select(F.lit(brand).alias("brand"), *parts)


def dashboard(
    search: DataFrame, products: DataFrame, reviews: DataFrame, tasks: DataFrame | None = None, top: int = 10
) -> DataFrame:
    """(section, name, metric, value) rows: table counts, the largest brands, review ratios in percent."""
    tables = {"search_results": search, "products": products, "reviews": reviews}
    if tasks is not None:
        tables["scrape_tasks"] = tasks

    def unpivoted(df, section, name, metrics):
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
        return df.select(
            F.lit(section).alias("section"), name.alias("name"), F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)")
        )

    stats = review_stats(reviews)
    for part in ("verified", "positive", "negative"):
        stats = stats.withColumn(f"{part}_percent", percent(F.col(f"{part}_count"), F.col("total")))
    shares = [f"{p}_{kind}" for p in ("verified", "positive", "negative") for kind in ("count", "percent")]
    return (
        unpivoted(table_counts(tables), "tables", F.col("table_name"), ["row_count"])
        .unionByName(
            unpivoted(brand_stats(products, top), "brands", F.col("brand"), ["product_count", "avg_rating", "total_reviews"])
        )
        .unionByName(unpivoted(stats, "reviews", F.lit("all"), ["total", "avg_rating", *shares]))
    )


def _brand_figures(products: DataFrame, reviews: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    rating = F.col("rating")
    of_products = products.groupBy(*keys).agg(
        F.avg(F.when(rating != 0, rating)).alias("avg_rating"),
        F.sum(F.coalesce("rating_count", F.lit(0))).alias("total_reviews"),
    )
    of_reviews = reviews.groupBy(*keys).agg(
        F.count("*").alias("review_total"),
        F.count_if(F.col("verified_purchase") == 1).alias("verified_count"),
        F.count_if(rating >= 4).alias("positive_count"),
        F.count_if(rating <= 2).alias("negative_count"),
    )
    return of_products, of_reviews


def brand_dashboards(search: DataFrame, products: DataFrame, reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Progress, rating and review ratios per brand, or of one brand."""
    progress = brand_progress(search, products, reviews, brand)
    if brand is not None:
        products, reviews = products.where(F.col("brand") == brand), reviews.where(F.col("brand") == brand)
    return dashboards_of(progress, *_brand_figures(products, reviews, ["brand"]))


def dashboards_of(progress: DataFrame, of_products: DataFrame, of_reviews: DataFrame) -> DataFrame:
    """Figures per brand put side by side."""
    out = progress
    for figures in (of_products, of_reviews):  # a brand that is not known is a brand of its own
        out = out.join(figures.withColumnRenamed("brand", "_brand"), out["brand"].eqNullSafe(F.col("_brand")), "left").drop("_brand")
    for part in ("verified", "positive", "negative"):
        out = out.withColumn(f"{part}_percent", percent(F.col(f"{part}_count"), F.col("review_total")))
    return out


def outcomes(requested: DataFrame, extracted: DataFrame) -> DataFrame:
    """Requested asins with whether they gave a product."""
    done = extracted.select("asin").distinct().withColumn("_done", F.lit(True))
    return requested.join(done, "asin", "left").select("asin", F.coalesce("_done", F.lit(False)).alias("succeeded"))


def outcome_counts(requested: DataFrame, extracted: DataFrame) -> DataFrame:
    ok = F.col("succeeded")
    return outcomes(requested, extracted).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def failed_asins(requested: DataFrame, extracted: DataFrame) -> DataFrame:
    """As rows: the list grows with the work, so it is never gathered into one value."""
    return requested.select("asin").join(extracted.select("asin"), "asin", "left_anti")
