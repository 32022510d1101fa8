"""Headline queries, timed one after the other; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.registry import queries
from shelfscope.session import local_session

HEADLINES = [
    "merged_view", "brand_stats", "price_distribution", "review_stats_by_asin", "brand_dashboards", "pending_products",
    "pending_reviews", "first_listing", "last_row_per_key", "review_page_cut", "work_batches", "upsert_reviews",
    "page_quality", "search_items", "product_details", "review_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of the first query
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        start = time.perf_counter()
        queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
