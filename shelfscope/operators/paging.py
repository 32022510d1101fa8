"""Which pages of a keyword or product count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.operators.dedup import first_review
from shelfscope.operators.joins import salted_join

# Fixed values.
SEARCH_PAGES = 100
REVIEW_PAGES = 10


def page_cap(pages: DataFrame, cap: int) -> DataFrame:
    return pages.where(F.col("page_no").between(1, cap))


def until_last_page(pages: DataFrame) -> DataFrame:
    """Drop pages behind a keyword's first page that has no next one.

    Expects one row per (keyword, page_no) under a page cap, so a keyword's window is a bounded group.
    """
    ends = F.min(F.when(~F.col("has_next"), F.col("page_no"))).over(Window.partitionBy("keyword"))
    kept = pages.withColumn("_ends", ends).where(F.col("_ends").isNull() | (F.col("page_no") <= F.col("_ends")))
    return kept.drop("_ends")


def review_page_stops(pages: DataFrame, cap: int = REVIEW_PAGES) -> DataFrame:
    """(asin, stop): the first page number that is missing, bad, or past page 1 and without a new review.

    ``pages`` has one row per page and review (asin, page_no, bad, review_id; NULL review_id on an empty
    page) and may be read twice. A product's usable page numbers are at most ``cap`` small integers.
    """
    pages = page_cap(pages, cap)
    first_seen = (
        pages.where(F.col("review_id").isNotNull())
        .groupBy("asin", "review_id")
        .agg(F.min("page_no").alias("page_no"))
        .select("asin", "page_no", F.lit(False).alias("bad"), F.lit(1).alias("new"))
    )
    per_page = (
        pages.select("asin", "page_no", "bad", F.lit(0).alias("new"))
        .unionByName(first_seen)
        .groupBy("asin", "page_no")
        .agg(F.max("bad").alias("bad"), F.max("new").alias("new"))
    )
    usable = ~F.col("bad") & ((F.col("page_no") == 1) | (F.col("new") > 0))
    steps = F.sequence(F.lit(1), F.lit(cap + 1))
    return per_page.groupBy("asin").agg(F.collect_set(F.when(usable, F.col("page_no").cast("int"))).alias("good")).select(
        "asin", F.get(F.array_except(steps, F.col("good")), F.lit(0)).alias("stop")
    )


def cut_review_pages(pages: DataFrame, cap: int = REVIEW_PAGES, **hot) -> DataFrame:
    """First occurrence of every review on the pages before its product's stop.

    ``pages`` is read more than once: pass stored or staged rows, not a fresh extraction.
    """
    listed = page_cap(pages, cap).where(F.col("review_id").isNotNull())
    stops = review_page_stops(pages, cap)
    cut = salted_join(first_review(listed), stops, "asin", "inner", spread_by=["review_id"], counted=listed, **hot)
    return cut.where(F.col("page_no") < F.col("stop")).drop("stop", "bad")
