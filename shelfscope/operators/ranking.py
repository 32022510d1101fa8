"""Top-N and ordered work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.session import stage


def top_for_review(products: DataFrame, top_n: int = 50, distinct_asin: bool = False) -> DataFrame:
    """Most-rated products. An asin stored under two brands can appear twice unless ``distinct_asin``."""
    rated = products.where(F.col("rating_count") > 0).select("asin", "rating_count")
    if distinct_asin:
        rated = rated.groupBy("asin").agg(F.max("rating_count").alias("rating_count"))
    return rated.orderBy(F.desc("rating_count"), "asin").limit(top_n)


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """1, 2, 3 … in the given order without gathering the rows in one task.

    The sorted rows are written once; each range then only needs the number of rows in the ranges before
    it. Those counts are one row per written range, which does not grow with the rows.
    """
    at = F.monotonically_increasing_id()
    placed = stage(
        df.orderBy(*order).select("*", F.shiftright(at, 33).alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_at"))
    )
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    rows = placed.join(F.broadcast(starts), "_range")
    return rows.withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


def batches(asins: DataFrame, order: list, size: int = 5) -> DataFrame:
    """Work batches in list order: ``position``, ``batch_no`` and ``batch_count`` on every asin."""
    rows = numbered(asins, order)
    total = rows.agg(F.count("*")).scalar()
    return rows.select(
        "*",
        (F.floor((F.col("position") - 1) / size) + 1).alias("batch_no"),
        F.ceil(total / F.lit(size)).cast("bigint").alias("batch_count"),
    )
