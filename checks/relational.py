"""Filters, projections, joins, aggregates, dedup, top-N: the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import base, oracle, view, views
from shelfscope.functions import text as X
from shelfscope.operators import dedup, filters, joins, merged, paging, ranking, stats

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *names: str):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql, *names) if names else sql.strip()
        return fn

    return register


SRP = ("search_results", "products", "reviews")
BIG = "CAST({0} AS BIGINT) AS {0}"


def _r(df, *cols, places=6):
    """Averages rounded, so that summation order does not show."""
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


# ---- filters ------------------------------------------------------------------------------------
@query("filter_brand_contains", """
SELECT asin, brand, CAST(brand <> '' AND (contains(lower(trim(brand)), 'brand#1') OR contains(lower(trim(brand)), '#25')) AS INT) AS is_target
FROM products""", "products")
def filter_brand_contains(spark, sf):
    p = view(spark, sf, "products")
    hit = filters.is_target_brand(F.col("brand"), [" Brand#1 ", "#25"])
    return p.select("asin", "brand", hit.cast("int").alias("is_target"))


@query("filter_brand_exact", """
SELECT asin, brand FROM products WHERE brand <> '' AND lower(trim(brand)) IN ('brand#1', 'brand#25')""", "products")
def filter_brand_exact(spark, sf):
    p = view(spark, sf, "products").select("asin", "brand")
    return filters.keep_target_brands(p, ["Brand#1", "BRAND#25 "], mode="exact")


@query("filter_brand_rejects", """
SELECT count(*) FILTER (WHERE brand <> '' AND contains(lower(brand), 'brand#2')) AS kept,
 count(*) FILTER (WHERE NOT (brand <> '' AND contains(lower(brand), 'brand#2'))) AS rejected FROM search_results""", "search_results")
def filter_brand_rejects(spark, sf):
    return filters.brand_filter_counts(view(spark, sf, "search_results"), ["Brand#2"])


@query("filter_run_brand", "SELECT asin, brand FROM products WHERE contains(lower(brand), 'brand#7')", "products")
def filter_run_brand(spark, sf):
    return filters.keep_run_brand(view(spark, sf, "products").select("asin", "brand"), "Brand#7")


@query("search_by_keyword", """
SELECT asin, search_keyword, brand, search_rank, seq FROM search_results WHERE search_keyword = '1-URGENT'
ORDER BY search_rank, asin, search_keyword, brand""", "search_results")
def search_by_keyword(spark, sf):
    s = view(spark, sf, "search_results").select("asin", "search_keyword", "brand", "search_rank", "seq")
    return filters.search_results(s, keyword="1-URGENT")


@query("products_by_asins_and_brand", """
SELECT asin, brand, rating_count FROM products
WHERE asin IN (SELECT asin FROM search_results WHERE is_best_seller = 1) AND brand = 'Brand#3'
ORDER BY rating_count DESC NULLS LAST, asin""", "products", "search_results")
def products_by_asins_and_brand(spark, sf):
    wanted = view(spark, sf, "search_results").where("is_best_seller = 1")
    return filters.products(view(spark, sf, "products"), wanted, brand="Brand#3").select("asin", "brand", "rating_count")


@query("products_in_list", """
SELECT asin, title, rating_count FROM products WHERE asin IN ('B000000001', 'B000000058', 'B000000777')
ORDER BY rating_count DESC NULLS LAST, asin LIMIT 2""", "products")
def products_in_list(spark, sf):
    p = view(spark, sf, "products")
    return filters.products(p, ["B000000001", "B000000058", "B000000777"], limit=2).select("asin", "title", "rating_count")


@query("product_by_asin", "SELECT asin, title, price FROM products WHERE asin = 'B000000042'", "products")
def product_by_asin(spark, sf):
    return filters.product(view(spark, sf, "products"), "B000000042").select("asin", "title", "price")


_DATED = "SELECT *, strftime(review_ts, '%B %-d, %Y') AS date FROM reviews"


def _dated(spark, sf):
    return view(spark, sf, "reviews").withColumn("date", F.date_format("review_ts", "MMMM d, yyyy"))


@query("reviews_filtered", f"""
WITH d AS ({_DATED})
SELECT asin, brand, review_id, rating, helpful_votes, date FROM d
WHERE brand = 'Brand#4' AND rating = 5 AND verified_purchase = 1""", "reviews")
def reviews_filtered(spark, sf):
    got = filters.reviews(_dated(spark, sf), brand="Brand#4", rating=5, verified_only=True)
    return got.select("asin", "brand", "review_id", "rating", "helpful_votes", "date")


@query("reviews_top_by_votes", f"""
WITH d AS ({_DATED})
SELECT asin, review_id, helpful_votes, date FROM d
ORDER BY helpful_votes DESC, date DESC, asin, review_id, brand LIMIT 100""", "reviews")
def reviews_top_by_votes(spark, sf):
    return filters.reviews(_dated(spark, sf), limit=100).select("asin", "review_id", "helpful_votes", "date")


@query("reviews_top_by_parsed_date", f"""
WITH d AS ({_DATED})
SELECT asin, review_id, helpful_votes, date FROM d
ORDER BY helpful_votes DESC, CAST(review_ts AS DATE) DESC, asin, review_id, brand LIMIT 100""", "reviews")
def reviews_top_by_parsed_date(spark, sf):
    got = filters.reviews(_dated(spark, sf), limit=100, order_by_parsed_date=True)
    return got.select("asin", "review_id", "helpful_votes", "date")


@query("rows_of_brand", """
SELECT 'search_results' AS part, asin FROM search_results WHERE brand = 'Brand#9'
UNION ALL SELECT 'products', asin FROM products WHERE brand = 'Brand#9'
UNION ALL SELECT 'reviews', asin FROM reviews WHERE brand = 'Brand#9'""", *SRP)
def rows_of_brand(spark, sf):
    parts = [
        filters.of_brand(df, "Brand#9").select(F.lit(name).alias("part"), "asin")
        for name, df in zip(SRP, views(spark, sf))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("distinct_search_asins", "SELECT DISTINCT asin FROM search_results", "search_results")
def distinct_search_asins(spark, sf):
    return filters.distinct_asins(view(spark, sf, "search_results"))


@query("product_asins", "SELECT asin FROM products", "products")
def product_asins(spark, sf):
    return view(spark, sf, "products").select("asin")


@query("brand_override", "SELECT asin, 'Acme' AS brand, search_rank FROM search_results", "search_results")
def brand_override(spark, sf):
    return filters.with_run_brand(view(spark, sf, "search_results"), "Acme").select("asin", "brand", "search_rank")


@query("ordered_products", """
SELECT asin, rating_count FROM products ORDER BY rating_count DESC NULLS LAST, asin""", "products")
def ordered_products(spark, sf):
    return filters.products(view(spark, sf, "products")).select("asin", "rating_count")


# ---- joins and sets -----------------------------------------------------------------------------
_MERGED = """
SELECT s.asin, s.search_keyword, s.search_rank, s.is_sponsored, s.is_amazon_choice, s.is_best_seller, p.title, p.brand,
 p.price, p.rating, p.rating_count, p.bsr_rank, p.bsr_category, p.is_fba, p.has_aplus, p.seller, p.first_available,
 (SELECT count(*) FROM reviews r WHERE r.asin = s.asin {count}) AS review_count
FROM search_results s LEFT JOIN products p ON s.asin = p.asin {on} {where}"""


@query("merged_view", _MERGED.format(count="", on="", where=""), *SRP)
def merged_all(spark, sf):
    return merged.merged_view(*views(spark, sf))


@query("merged_view_brand", _MERGED.format(
    count="AND r.brand = 'Brand#11'", on="", where="WHERE s.brand = 'Brand#11'"), *SRP)
def merged_brand(spark, sf):
    return merged.merged_view(*views(spark, sf), brand="Brand#11")


@query("merged_view_own_brand", _MERGED.format(count="", on="AND s.brand = p.brand", where=""), *SRP)
def merged_own_brand(spark, sf):
    return merged.merged_view(*views(spark, sf), match_brand=True)


_FANNED = """
WITH two AS (SELECT * FROM products UNION ALL SELECT * REPLACE (concat(brand, '*') AS brand) FROM products WHERE asin LIKE '%4')
SELECT s.asin, s.search_keyword, s.search_rank, p.brand, p.title,
 (SELECT count(*) FROM reviews r WHERE r.asin = s.asin) AS review_count
FROM search_results s LEFT JOIN two p ON s.asin = p.asin"""


@query("merged_view_skewed", _FANNED, *SRP)
def merged_skewed(spark, sf):
    """Asins stored under two brands fan out; a low bound makes many keys hot and cuts them into pieces."""
    s, p, r = views(spark, sf)
    again = p.where(F.endswith(p.asin, F.lit("4"))).withColumn("brand", F.concat("brand", F.lit("*")))
    got = merged.merged_view(s, p.unionByName(again), r, ordered=False, min_rows=5)
    return got.select("asin", "search_keyword", "search_rank", "brand", "title", "review_count")


@query("review_counts", "SELECT asin, count(*) AS review_count FROM reviews GROUP BY asin", "reviews")
def review_counts(spark, sf):
    return merged.review_counts(view(spark, sf, "reviews"))


@query("pending_products", "SELECT asin FROM search_results EXCEPT SELECT asin FROM products WHERE brand <> ''", "search_results", "products")
def pending_products(spark, sf):
    s, p, _ = views(spark, sf)
    return merged.pending_products(s, p.where("brand <> ''"))


@query("pending_reviews", """
WITH t AS (SELECT asin, rating_count FROM products WHERE rating_count > 0 ORDER BY rating_count DESC, asin LIMIT 200)
SELECT asin, rating_count FROM t WHERE asin NOT IN (SELECT asin FROM reviews GROUP BY asin HAVING count(*) > 32)""", "products", "reviews")
def pending_reviews(spark, sf):
    _, p, r = views(spark, sf)
    return merged.pending_reviews(p, r, top_n=200, min_reviews=32)


@query("asins_in_work_list", """
SELECT r.asin, r.review_id FROM reviews r WHERE r.asin IN (SELECT asin FROM products WHERE rating_count > 4000)""", "reviews", "products")
def asins_in_work_list(spark, sf):
    _, p, r = views(spark, sf)
    return joins.in_work_list(r, p.where("rating_count > 4000"), ["review_id"]).select("asin", "review_id")


@query("concatenated_batches", """
SELECT asin, search_keyword, search_rank FROM search_results WHERE search_keyword = '1-URGENT'
UNION ALL SELECT asin, search_keyword, search_rank FROM search_results WHERE search_keyword = '5-LOW'""", "search_results")
def concatenated_batches(spark, sf):
    s = view(spark, sf, "search_results").select("asin", "search_keyword", "search_rank")
    return s.where("search_keyword = '1-URGENT'").unionByName(s.where("search_keyword = '5-LOW'"))


# ---- aggregates ---------------------------------------------------------------------------------
_BRANDS = """SELECT brand, count(*) AS product_count, round(avg(rating), 6) AS avg_rating,
 CAST(sum(rating_count) AS BIGINT) AS total_reviews, round(avg(bsr_rank), 6) AS avg_bsr
FROM products WHERE brand IS NOT NULL AND brand <> '' {0} GROUP BY brand ORDER BY product_count DESC, brand"""


@query("brand_stats", _BRANDS.format("") + " LIMIT 50", "products")
def brand_stats(spark, sf):
    return _r(stats.brand_stats(view(spark, sf, "products")), "avg_rating", "avg_bsr")


@query("brand_stats_one", _BRANDS.format("AND brand = 'Brand#5'"), "products")
def brand_stats_one(spark, sf):
    return _r(stats.brand_stats(view(spark, sf, "products"), brand="Brand#5"), "avg_rating", "avg_bsr")


_PRICE = r"""TRY_CAST(nullif(regexp_extract(replace(replace(price, '$', ''), ',', ''), '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE)"""


@query("price_distribution", f"""
WITH v AS (SELECT coalesce({_PRICE}, 0) AS v FROM products WHERE price IS NOT NULL AND price <> '')
SELECT CASE WHEN v < 20 THEN '0-20' WHEN v < 50 THEN '20-50' WHEN v < 100 THEN '50-100' WHEN v < 200 THEN '100-200' ELSE '200+' END
 AS price_range, count(*) AS count FROM v GROUP BY 1""", "products")
def price_distribution(spark, sf):
    return stats.price_distribution(view(spark, sf, "products"))


_REVIEW_FIGURES = """count(*) AS total, round(avg(rating), 6) AS avg_rating,
 CAST(sum(CASE WHEN verified_purchase = 1 THEN 1 ELSE 0 END) AS BIGINT) AS verified_count,
 CAST(sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS positive_count,
 CAST(sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS negative_count"""


@query("review_stats", f"SELECT {_REVIEW_FIGURES} FROM reviews", "reviews")
def review_stats(spark, sf):
    return _r(stats.review_stats(view(spark, sf, "reviews")), "avg_rating")


@query("review_stats_one", f"SELECT {_REVIEW_FIGURES} FROM reviews WHERE asin = 'B000000123'", "reviews")
def review_stats_one(spark, sf):
    return _r(stats.review_stats(view(spark, sf, "reviews"), "B000000123"), "avg_rating")


@query("review_stats_by_asin", f"SELECT asin, {_REVIEW_FIGURES} FROM reviews GROUP BY asin", "reviews")
def review_stats_by_asin(spark, sf):
    return _r(stats.review_stats_by_asin(view(spark, sf, "reviews")), "avg_rating")


@query("brand_progress", """
WITH b AS (SELECT brand, 's' AS k FROM search_results UNION ALL SELECT brand, 'p' FROM products UNION ALL SELECT brand, 'r' FROM reviews)
SELECT brand, count(*) FILTER (WHERE k = 's') AS search_results, count(*) FILTER (WHERE k = 'p') AS products,
 count(*) FILTER (WHERE k = 'r') AS reviews FROM b GROUP BY brand""", *SRP)
def brand_progress(spark, sf):
    return stats.brand_progress(*views(spark, sf))


_PROGRESS_ONE = """SELECT '{0}' AS brand, (SELECT count(*) FROM search_results WHERE brand = '{0}') AS search_results,
 (SELECT count(*) FROM products WHERE brand = '{0}') AS products, (SELECT count(*) FROM reviews WHERE brand = '{0}') AS reviews"""


@query("brand_progress_one", _PROGRESS_ONE.format("Brand#8"), *SRP)
def brand_progress_one(spark, sf):
    return stats.brand_progress(*views(spark, sf), brand="Brand#8")


@query("brand_progress_unknown", _PROGRESS_ONE.format("Nobody"), *SRP)
def brand_progress_unknown(spark, sf):
    return stats.brand_progress(*views(spark, sf), brand="Nobody")


@query("heavily_reviewed", "SELECT asin FROM reviews GROUP BY asin HAVING count(*) > 40", "reviews")
def heavily_reviewed(spark, sf):
    return merged.heavily_reviewed(view(spark, sf, "reviews"), 40)


_PCT = "round(100.0 * count(*) FILTER (WHERE {0}) / count(*), 1)"
_KINDS = {"verified": "verified_purchase = 1", "positive": "rating >= 4", "negative": "rating <= 2"}


@query("dashboard", f"""
WITH b AS (SELECT brand, count(*) AS n, avg(rating) AS a, sum(rating_count) AS t FROM products WHERE brand <> '' GROUP BY brand
 ORDER BY n DESC, brand LIMIT 10)
SELECT 'tables' AS section, 'search_results' AS name, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM search_results
UNION ALL SELECT 'tables', 'products', 'row_count', count(*) FROM products
UNION ALL SELECT 'tables', 'reviews', 'row_count', count(*) FROM reviews
UNION ALL SELECT 'brands', brand, 'product_count', n FROM b UNION ALL SELECT 'brands', brand, 'avg_rating', round(a, 6) FROM b
UNION ALL SELECT 'brands', brand, 'total_reviews', t FROM b
UNION ALL SELECT 'reviews', 'all', 'total', count(*) FROM reviews UNION ALL SELECT 'reviews', 'all', 'avg_rating', round(avg(rating), 6) FROM reviews
""" + "".join(f"""UNION ALL SELECT 'reviews', 'all', '{k}_count', count(*) FILTER (WHERE {c}) FROM reviews
UNION ALL SELECT 'reviews', 'all', '{k}_percent', {_PCT.format(c)} FROM reviews
""" for k, c in _KINDS.items()), *SRP)
def dashboard(spark, sf):
    return _r(stats.dashboard(*views(spark, sf)), "value")


@query("brand_dashboards", """
WITH b AS (SELECT brand, 's' AS k FROM search_results UNION ALL SELECT brand, 'p' FROM products UNION ALL SELECT brand, 'r' FROM reviews),
g AS (SELECT brand, count(*) FILTER (WHERE k = 's') AS search_results, count(*) FILTER (WHERE k = 'p') AS products,
 count(*) FILTER (WHERE k = 'r') AS reviews FROM b GROUP BY brand),
p AS (SELECT brand, round(avg(rating) FILTER (WHERE rating <> 0), 6) AS avg_rating, CAST(sum(coalesce(rating_count, 0)) AS BIGINT) AS total_reviews
 FROM products GROUP BY brand),
r AS (SELECT brand, count(*) AS review_total, """ + ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {k}_count, {_PCT.format(c)} AS {k}_percent" for k, c in _KINDS.items()) + """
 FROM reviews GROUP BY brand)
SELECT * FROM g LEFT JOIN p USING (brand) LEFT JOIN r USING (brand)""", *SRP)
def brand_dashboards(spark, sf):
    return _r(stats.brand_dashboards(*views(spark, sf)), "avg_rating")


@query("brand_dashboard_one", """
SELECT 'Brand#6' AS brand, (SELECT count(*) FROM products WHERE brand = 'Brand#6') AS products,
 (SELECT round(avg(rating) FILTER (WHERE rating <> 0), 6) FROM products WHERE brand = 'Brand#6') AS avg_rating,
 count(*) AS review_total, """ + _PCT.format("rating >= 4") + """ AS positive_percent
FROM reviews WHERE brand = 'Brand#6'""", *SRP)
def brand_dashboard_one(spark, sf):
    got = _r(stats.brand_dashboards(*views(spark, sf), brand="Brand#6"), "avg_rating")
    return got.select("brand", "products", "avg_rating", "review_total", "positive_percent")


@query("batch_outcome_counts", """
WITH w AS (SELECT DISTINCT asin FROM search_results)
SELECT count(*) FILTER (WHERE asin IN (SELECT asin FROM products WHERE rating IS NOT NULL)) AS succeeded,
 count(*) FILTER (WHERE asin NOT IN (SELECT asin FROM products WHERE rating IS NOT NULL)) AS failed FROM w""", "search_results", "products")
def batch_outcome_counts(spark, sf):
    s, p, _ = views(spark, sf)
    return stats.outcome_counts(filters.distinct_asins(s), p.where("rating IS NOT NULL"))


@query("batch_failed_asins", """
SELECT DISTINCT asin FROM search_results WHERE asin NOT IN (SELECT asin FROM products WHERE rating IS NOT NULL)""", "search_results", "products")
def batch_failed_asins(spark, sf):
    s, p, _ = views(spark, sf)
    return stats.failed_asins(filters.distinct_asins(s), p.where("rating IS NOT NULL"))


# ---- dedup, top-N, batches ----------------------------------------------------------------------
_ITEM_COLS = ["asin", "search_keyword", "page_no", "pos", "seq"]


def _items(spark, sf):
    s = view(spark, sf, "search_results")
    return s.withColumns(
        {
            "keyword_ord": F.substring("search_keyword", 1, 1).cast("int"),
            "page_no": F.expr("cast((search_rank - 1) div 48 + 1 as int)"),
            "pos": F.col("seq"),
        }
    )


_ITEMS = "SELECT *, CAST(substr(search_keyword, 1, 1) AS INT) AS keyword_ord, CAST((search_rank - 1) // 48 + 1 AS INT) AS page_no, seq AS pos FROM search_results"


@query("first_listing_per_keyword", f"""
WITH i AS ({_ITEMS})
SELECT asin, search_keyword, page_no, pos, seq FROM i
QUALIFY row_number() OVER (PARTITION BY search_keyword, asin ORDER BY page_no, pos) = 1""", "search_results")
def first_listing_per_keyword(spark, sf):
    return dedup.first_listing_per_keyword(_items(spark, sf)).select(*_ITEM_COLS)


@query("first_listing", f"""
WITH i AS ({_ITEMS}),
k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY search_keyword, asin ORDER BY page_no, pos) = 1)
SELECT asin, search_keyword, page_no, pos, seq FROM k
QUALIFY row_number() OVER (PARTITION BY asin ORDER BY keyword_ord, page_no, pos) = 1""", "search_results")
def first_listing(spark, sf):
    return dedup.first_listing(_items(spark, sf)).select(*_ITEM_COLS)


@query("first_review", """
SELECT asin, review_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY asin, review_id ORDER BY review_ts, seq) AS n FROM reviews)
WHERE n = 1""", "reviews")
def first_review(spark, sf):
    return dedup.first_review(view(spark, sf, "reviews"), ("review_ts", "seq")).select("asin", "review_id", "seq")


@query("last_row_per_key", """
SELECT asin, review_id, brand, rating, seq FROM (SELECT *, row_number() OVER (PARTITION BY asin, review_id, brand ORDER BY review_ts DESC, seq DESC) AS n
 FROM reviews) WHERE n = 1""", "reviews")
def last_row_per_key(spark, sf):
    got = dedup.last_per(view(spark, sf, "reviews"), ["asin", "review_id", "brand"], ["review_ts", "seq"])
    return got.select("asin", "review_id", "brand", "rating", "seq")


@query("top_for_review", """
SELECT asin, rating_count FROM products WHERE rating_count > 0 ORDER BY rating_count DESC, asin LIMIT 50""", "products")
def top_for_review(spark, sf):
    return ranking.top_for_review(view(spark, sf, "products"))


@query("top_brands", _BRANDS.format("") + " LIMIT 10", "products")
def top_brands(spark, sf):
    return _r(stats.brand_stats(view(spark, sf, "products"), limit=10), "avg_rating", "avg_bsr")


@query("work_batches", """
WITH w AS (SELECT asin, rating_count, row_number() OVER (ORDER BY rating_count DESC, asin) AS position FROM products WHERE rating_count > 0)
SELECT asin, rating_count, position, (position - 1) // 5 + 1 AS batch_no, (SELECT (count(*) + 4) // 5 FROM w) AS batch_count FROM w""", "products")
def work_batches(spark, sf):
    p = view(spark, sf, "products").where("rating_count > 0").select("asin", "rating_count")
    return ranking.batches(p, [F.desc("rating_count"), F.asc("asin")])


# ---- pagination over stored rows ------------------------------------------------------------------
_PAGED = """SELECT l_partkey AS k, concat('B', lpad(cast(l_partkey AS string), 9, '0')) AS asin, l_linenumber AS page_no,
 l_orderkey % 97 = 0 AS bad, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE concat('R', cast(l_orderkey % 40 AS string)) END AS review_id,
 l_orderkey AS pos, l_quantity AS rating, l_extendedprice AS tie FROM lineitem"""


def _paged(spark, sf):
    got = spark.sql(_PAGED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=base(spark, sf, "lineitem"))
    return got.withColumn("page_no", F.col("page_no").cast("int"))


_CUT = """
WITH rv AS ({paged}),
pg AS (SELECT asin, page_no, bool_or(bad) AS bad FROM rv WHERE page_no <= {cap} GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY asin, review_id ORDER BY page_no, pos, tie) AS rn FROM rv WHERE review_id IS NOT NULL AND page_no <= {cap}),
n AS (SELECT asin, page_no, count(*) AS cnt FROM f WHERE rn = 1 GROUP BY 1, 2),
p AS (SELECT pg.*, coalesce(n.cnt, 0) AS cnt, row_number() OVER (PARTITION BY pg.asin ORDER BY pg.page_no) AS expected
 FROM pg LEFT JOIN n USING (asin, page_no)),
s AS (SELECT asin, min(page_no) FILTER (WHERE bad OR page_no <> expected OR (page_no > 1 AND cnt = 0)) AS stop FROM p GROUP BY asin)
SELECT asin, page_no, review_id, pos FROM f JOIN s USING (asin) WHERE rn = 1 AND page_no < coalesce(stop, 2147483647)"""


def _cut(spark, sf, **hot):
    paged = _paged(spark, sf)
    kept = paging.cut_review_pages(paged.select("asin", "page_no", "bad", "review_id", F.struct("pos", "tie").alias("pos")), 10, **hot)
    return kept.select("asin", "page_no", "review_id", "pos.pos")


@query("review_page_cut", _CUT.format(paged=_PAGED, cap=10))
def review_page_cut(spark, sf):
    return _cut(spark, sf)


@query("review_page_cut_skewed", _CUT.format(paged=_PAGED, cap=10))
def review_page_cut_skewed(spark, sf):
    """The same rows with nearly every product treated as hot."""
    return _cut(spark, sf, min_rows=4)


@query("search_page_end", """
WITH p AS (SELECT o_orderpriority AS keyword, CAST(o_orderkey // 48 % 100 + 1 AS INT) AS page_no, bool_and(o_orderkey // 48 % 100 + 1 < 90 - o_orderkey // 48 // 100) AS has_next
 FROM orders GROUP BY 1, 2)
SELECT keyword, page_no, CAST(has_next AS INT) AS has_next FROM p
WHERE page_no <= coalesce((SELECT min(q.page_no) FROM p q WHERE q.keyword = p.keyword AND NOT q.has_next), 1000)""")
def search_page_end(spark, sf):
    page = "cast((o_orderkey div 48) % 100 + 1 as int)"
    pages = (
        base(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("keyword"), F.expr(page).alias("page_no"))
        .agg(F.min(F.expr(f"{page} < 90 - (o_orderkey div 48) div 100")).alias("has_next"))
    )
    capped = paging.page_cap(pages, paging.SEARCH_PAGES)
    return paging.until_last_page(capped).withColumn("has_next", F.col("has_next").cast("int"))


@query("page_cap", "SELECT l_orderkey, l_linenumber AS page_no FROM lineitem WHERE l_linenumber BETWEEN 1 AND 3")
def page_cap(spark, sf):
    return paging.page_cap(base(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page_no")), 3)
