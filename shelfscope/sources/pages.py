"""The page store: where extraction starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope import schemas
from shelfscope.functions import text as X

# Where a page address carries its kind, product and position.
SEARCH_PATH = r"^https?://[^/]+/s\?"
PRODUCT_PATH = r"/dp/([A-Za-z0-9]+)"
REVIEW_PATH = r"/product-reviews/([A-Za-z0-9]+)"
KEYWORD = r"[?&]k=([^&#]*)"
SEARCH_PAGE = r"[?&]page=(\d+)"
REVIEW_PAGE = r"[?&]pageNumber=(\d+)"

#: Folders by asin (search pages: by keyword) within a kind. A store is written and read with one number; a store of many terabytes takes thousands.
BUCKETS = 64

# Parsing a page is CPU work, so scan splits should be small: a reader cannot split below a row group.
ROW_GROUP_BYTES = 16 * 1024 * 1024


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A stored page table. Context columns it has are taken as they are, so a filter on ``page_kind`` or the bucket still
    picks folders; those it lacks come from the address."""
    return with_context(spark.read.parquet(path), fill_nulls=False)


def with_context(pages: DataFrame, fill_nulls: bool = True) -> DataFrame:
    """Fill page kind, keyword, page number and asin from the address where they are missing or NULL."""
    url = F.col("url")
    product, review = X.extract(url, PRODUCT_PATH), X.extract(url, REVIEW_PATH)
    kind = (
        F.when(F.rlike(url, F.lit(SEARCH_PATH)), F.lit("search"))
        .when(review.isNotNull(), F.lit("review"))
        .when(product.isNotNull(), F.lit("product"))
    )
    number = F.coalesce(X.extract(url, SEARCH_PAGE), X.extract(url, REVIEW_PAGE))
    derived = {
        "page_kind": kind,
        "keyword": F.when(kind == "search", X.keyword_from_url(X.extract(url, KEYWORD))),
        "page_no": F.when(kind.isNotNull(), F.coalesce(number.try_cast("int"), F.lit(1))),
        "asin": F.when(kind == "review", review).when(kind == "product", product),
    }
    out = []
    for field in schemas.struct(schemas.PAGES):
        value = derived.get(field.name, F.lit(None))
        if field.name in pages.columns:
            stored = F.col(field.name)
            value = F.coalesce(stored, value) if fill_nulls and field.name in derived else stored
        out.append(value.cast(field.dataType).alias(field.name))
    return pages.select(*out, *(c for c in (schemas.PAGE_BUCKET,) if c in pages.columns))


def page_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key, F.lit(""))), F.lit(buckets)).cast("int")


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Keep raw pages for later extraction, one folder per kind so a job reads only its own."""
    writer = pages.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES)
    writer.partitionBy("page_kind").parquet(path)


def write_page_store(pages: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """``write_pages`` laid out for work lists: folders by kind and bucket, rows by asin, so a list of products reads the row groups that may hold them.

    This is the one place where HTML goes through an exchange: once, when pages are stored.
    """
    laid = pages.withColumn(schemas.PAGE_BUCKET, page_bucket(F.coalesce("asin", "keyword"), buckets)).hint("rebalance", "page_kind", schemas.PAGE_BUCKET)
    writer = laid.sortWithinPartitions("page_kind", schemas.PAGE_BUCKET, "asin", "page_no").write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES)
    writer.partitionBy("page_kind", schemas.PAGE_BUCKET).parquet(path)
