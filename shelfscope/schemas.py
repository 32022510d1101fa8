"""Record schemas (as Spark DDL), keys and defaults of the stored tables and of the page store."""

from __future__ import annotations

from pyspark.sql import types as T

RANK = "struct<rank:bigint,category:string,url:string>"
VARIANT = "struct<asin:string,value:string,available:boolean>"

PAGES = (
    "page_id bigint, url string, html string, page_kind string, keyword string, keyword_ord int, "
    "page_no int, asin string, brand string, fetched_at timestamp"
)

# A page store may be laid out in folders by this number as well.
PAGE_BUCKET = "page_bucket"

SEARCH_RESULTS = (
    "asin string not null, brand string, search_keyword string, search_rank bigint, title string, price string, "
    "original_price string, rating double, rating_count bigint, is_sponsored int, is_amazon_choice int, "
    "is_best_seller int, url string, image_url string, created_at timestamp"
)

PRODUCTS = (
    "asin string not null, brand string, title string, price string, original_price string, rating double, "
    "rating_count bigint, rating_5_star int, rating_4_star int, rating_3_star int, rating_2_star int, "
    "rating_1_star int, bought_count string, bought_count_number bigint, bsr_rank bigint, bsr_category string, "
    f"sub_category_ranks array<{RANK}>, bullet_points array<string>, description string, "
    f"images array<string>, variants array<{VARIANT}>, seller string, is_fba int, has_aplus int, "
    "first_available string, availability string, created_at timestamp, updated_at timestamp"
)

REVIEWS = (
    "asin string not null, brand string, review_id string not null, title string, content string, rating int, "
    "date string, verified_purchase int, helpful_votes int, author string, variant string, created_at timestamp"
)

SCRAPE_TASKS = (
    "task_type string not null, target string not null, brand string, status string, retry_count int, "
    "error_message string, created_at timestamp, updated_at timestamp"
)

TABLES = {
    "search_results": SEARCH_RESULTS,
    "products": PRODUCTS,
    "reviews": REVIEWS,
    "scrape_tasks": SCRAPE_TASKS,
}

KEYS = {
    "search_results": ["asin", "search_keyword", "brand"],
    "products": ["asin", "brand"],
    "reviews": ["asin", "review_id", "brand"],
    "scrape_tasks": ["task_type", "target"],
}

# What a column holds when a record does not bring it; columns not listed default to NULL.
DEFAULTS = {
    "search_results": {"is_sponsored": 0, "is_amazon_choice": 0, "is_best_seller": 0},
    "products": {
        "rating_5_star": 0, "rating_4_star": 0, "rating_3_star": 0, "rating_2_star": 0, "rating_1_star": 0,
        "bought_count": "", "bought_count_number": 0, "is_fba": 0, "has_aplus": 0,
    },
    "reviews": {"verified_purchase": 0, "helpful_votes": 0},
    "scrape_tasks": {"status": "pending", "retry_count": 0},
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def columns(table: str) -> list[str]:
    return struct(TABLES[table]).names
