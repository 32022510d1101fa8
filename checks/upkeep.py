"""Kept figures and joins after several upserts that add and replace rows: they equal what the whole tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, view
from shelfscope.plans import upkeep
from shelfscope.session import scratch_path, stage
from shelfscope.sources.tables import Store

QUERIES, ORACLES = {}, {}

# Batch n brings the rows whose number leaves a remainder of n or more; a row holds what its last batch said.
_P = "CAST(substr(asin, 2) AS BIGINT)"
_PRODUCTS = f"""pd AS (SELECT asin, brand, title, price, rating + {_P} % 5 AS rating, CASE WHEN {_P} % 7 = 3 THEN NULL ELSE rating_count + 1000 * ({_P} % 5) END AS rating_count,
  CASE WHEN {_P} % 11 = 5 THEN NULL ELSE bsr_rank END AS bsr_rank, bsr_category, is_fba, has_aplus, seller, first_available FROM products)"""

def query(name: str, sql: str, *names: str):
    def register(fn):
        QUERIES[name], ORACLES[name] = fn, oracle(sql, *names)
        return fn

    return register


def _reviews(spark, sf):
    """One row per key: the SQL does the same, as the view repeats review numbers."""
    rows = view(spark, sf, "reviews")
    last = lambda c: F.max_by(c, "seq").alias(c)
    return rows.groupBy("asin", "brand", "review_id").agg(last("rating"), last("verified_purchase"), last("helpful_votes"))


def _fill(spark, sf, after, tables=("products", "reviews", "search_results")):
    """Five rounds of upserts into ``tables``; what ``after`` makes is updated behind each, as a job would."""
    root = scratch_path(spark, "kept")
    store = Store(spark, f"{root}/store", buckets=8).create()
    products, search = view(spark, sf, "products"), view(spark, sf, "search_results")
    reviews = stage(_reviews(spark, sf)) if "reviews" in tables else None
    number = F.substring("asin", 2, 9).cast("bigint")
    kept = after(store, f"{root}/kept")
    for n in range(5):
        said = {
            "rating": F.col("rating") + n, "bsr_rank": F.when((number % 11 != 5) | (number % 5 > n), F.col("bsr_rank")),
            "rating_count": F.when((number % 7 != 3) | (number % 5 > n), F.col("rating_count") + 1000 * n),
        }
        if "products" in tables:
            store["products"].upsert(products.where(number % 5 >= n).withColumns(said))
        changed = {"rating": F.col("rating") + n, "verified_purchase": (F.col("verified_purchase") + n) % 2}
        if "reviews" in tables:
            store["reviews"].upsert(reviews.where(F.col("helpful_votes") % 5 >= n).withColumns(changed))
        if "search_results" in tables:
            store["search_results"].upsert(search.where(number % 5 >= n))
        kept.update()
    return kept


def _figures(spark, sf, *tables):
    return _fill(spark, sf, upkeep.KeptFigures, tables)


@query("kept_brand_stats", f"""WITH {_PRODUCTS}
SELECT brand, count(*) AS product_count, avg(rating) AS avg_rating, CAST(sum(rating_count) AS BIGINT) AS total_reviews, avg(bsr_rank) AS avg_bsr FROM pd WHERE brand <> '' GROUP BY brand""", "products")
def kept_brand_stats(spark, sf):
    return _figures(spark, sf, "products").brand_stats(limit=None)


@query("kept_review_stats_by_asin", f"""WITH rw AS (SELECT asin, brand, review_id, max_by(rating, seq) AS rating, max_by(verified_purchase, seq) AS v, max_by(helpful_votes, seq) AS h FROM reviews GROUP BY ALL),
x AS (SELECT asin, rating + h % 5 AS rating, (v + h % 5) % 2 AS v FROM rw)
SELECT asin, count(*) AS total, avg(rating) AS avg_rating, count(*) FILTER (v = 1) AS verified_count, count(*) FILTER (rating >= 4) AS positive_count,
 count(*) FILTER (rating <= 2) AS negative_count FROM x GROUP BY asin""", "reviews")
def kept_review_stats_by_asin(spark, sf):
    return _figures(spark, sf, "reviews").review_stats_by_asin()


@query("kept_brand_dashboards", f"""WITH {_PRODUCTS}, rw AS (SELECT asin, brand, review_id, max_by(rating, seq) AS rating, max_by(verified_purchase, seq) AS v, max_by(helpful_votes, seq) AS h FROM reviews GROUP BY ALL),
x AS (SELECT brand, rating + h % 5 AS rating, (v + h % 5) % 2 AS v FROM rw),
s AS (SELECT brand, count(*) AS search_results FROM (SELECT DISTINCT asin, search_keyword, brand FROM search_results) GROUP BY brand),
p AS (SELECT brand, count(*) AS products, avg(rating) FILTER (rating <> 0) AS avg_rating, CAST(sum(coalesce(rating_count, 0)) AS BIGINT) AS total_reviews FROM pd GROUP BY brand),
r AS (SELECT brand, count(*) AS reviews, count(*) FILTER (v = 1) AS verified_count, count(*) FILTER (rating >= 4) AS positive_count, count(*) FILTER (rating <= 2) AS negative_count FROM x GROUP BY brand)
SELECT brand, coalesce(search_results, 0) AS search_results, coalesce(products, 0) AS products, coalesce(reviews, 0) AS reviews, avg_rating, total_reviews, reviews AS review_total,
 verified_count, positive_count, negative_count FROM s FULL JOIN p USING (brand) FULL JOIN r USING (brand)""", "products", "reviews", "search_results")
def kept_brand_dashboards(spark, sf):
    return _figures(spark, sf, "products", "reviews", "search_results").brand_dashboards().drop("verified_percent", "positive_percent", "negative_percent")


@query("kept_merged_view", f"""WITH {_PRODUCTS}, c AS (SELECT asin, count(*) AS n FROM (SELECT DISTINCT asin, brand, review_id FROM reviews) GROUP BY asin),
s AS (SELECT DISTINCT asin, search_keyword, brand FROM search_results)
SELECT s.asin, s.search_keyword, title, pd.brand, price, rating, rating_count, bsr_rank, coalesce(n, 0) AS review_count
FROM s LEFT JOIN pd ON pd.asin = s.asin LEFT JOIN c ON c.asin = s.asin""", "products", "reviews", "search_results")
def kept_merged_view(spark, sf):
    kept = _fill(spark, sf, upkeep.KeptMerged).read(ordered=False)
    return kept.select("asin", "search_keyword", "title", "brand", "price", "rating", "rating_count", "bsr_rank", "review_count")
