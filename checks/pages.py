"""Page store, page quality and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import markup
from checks.views import base
from shelfscope.operators import extract_product, extract_review, extract_search, quality
from shelfscope.session import scratch_path
from shelfscope.sources import pages as store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


_A = "concat('B', lpad(CAST({0} AS VARCHAR), 9, '0'))"

# ---- page store and quality -----------------------------------------------------------------------
_CONTEXT = f"""
SELECT 'product' AS page_kind, CAST(NULL AS VARCHAR) AS keyword, CAST(1 AS INT) AS page_no, {_A.format('p_partkey')} AS asin, p_partkey AS page_id FROM part
UNION ALL SELECT 'search', 'kitchen word' || CAST(o_orderkey % 40 AS VARCHAR), CAST(o_orderkey // 40 + 1 AS INT), NULL, o_orderkey FROM orders
UNION ALL SELECT NULL, NULL, NULL, NULL, page_id FROM pages"""


def _bare_pages(spark, sf):
    bare = ["page_id", "url", "html"]
    shop = markup.product_pages(spark, sf).select(*bare).unionByName(markup.search_pages(spark, sf).select(*bare))
    return shop.unionByName(base(spark, sf, "pages").select(*bare))


@query("page_context_from_address", _CONTEXT)
def page_context_from_address(spark, sf):
    got = store.with_context(_bare_pages(spark, sf))
    return got.select("page_kind", "keyword", "page_no", "asin", "page_id")


@query("page_store_round_trip", _CONTEXT)
def page_store_round_trip(spark, sf):
    path = scratch_path(spark, "pages")
    store.write_pages(store.with_context(_bare_pages(spark, sf)), path)
    return store.read_pages(spark, path).select("page_kind", "keyword", "page_no", "asin", "page_id")


@query("page_scan", "SELECT page_id, url, length(html) AS chars FROM pages")
def page_scan(spark, sf):
    return store.with_context(base(spark, sf, "pages")).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


_MARKS = {
    0: "<html><head><title>Sorry! Something went wrong</title></head></html>",
    1: '<form method="get" action="/errors/validateCaptcha"><input type="text" id="captchacharacters" name="f"></form>',
    2: '<div class="a-row captcha-box">x</div>',
    3: "<IMG alt='' SRC='https://i.example/captcha/1.jpg'>",
    4: "<title>Robot Check</title>",
    5: "<a href='/gp/sign-in.html'>Sign in</a>",
    6: "<p>class=captcha but no tag</p>",
    7: "<body>We're sorry, try later</body>",
}


@query("page_quality", """
SELECT page_id, CAST(page_id % 9 IN (1, 2, 3) AS INT) AS captcha, CAST(page_id % 9 IN (0, 4, 7) AS INT) AS blocked,
 CAST(page_id % 9 = 5 OR page_id % 9 = 8 AS INT) AS sign_in FROM pages""")
def page_quality(spark, sf):
    """The driver's pages, each with a mark of one kind put in front (kind 8 is a sign-in address)."""
    kind = F.col("page_id") % 9
    mark = F.lit("")
    for n, html in _MARKS.items():
        mark = F.when(kind == n, F.lit(html)).otherwise(mark)
    url = F.when(kind == 8, F.concat(F.lit("https://www.amazon.com/ap/signin?x="), "page_id")).otherwise(F.col("url"))
    marked = base(spark, sf, "pages").select("page_id", url.alias("url"), F.concat(mark, "html").alias("html"))
    got = quality.classify(marked)
    return got.select("page_id", *[F.col(c).cast("int").alias(c) for c in ("captcha", "blocked", "sign_in")])


@query("plain_pages_are_readable", "SELECT page_id FROM pages")
def plain_pages_are_readable(spark, sf):
    return quality.readable(base(spark, sf, "pages")).select("page_id")


@query("page_titles", """
SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is') AS title FROM pages""")
def page_titles(spark, sf):
    return base(spark, sf, "pages").select("page_id", quality.page_title(F.col("html")).alias("title"))


@query("articles_hold_no_reviews", "SELECT page_id FROM pages WHERE page_id < 0")
def articles_hold_no_reviews(spark, sf):
    """The DOM pass over real, partly malformed article pages."""
    pages = base(spark, sf, "pages").withColumn("asin", F.lit(""))
    return extract_review.reviews(pages).select("page_id")


@query("review_selector_audit", """
SELECT 'div[data-hook="review"]' AS selector, CAST(count(*) FILTER (WHERE l_orderkey % 3 = 0) * 2 AS BIGINT) AS elements, count(*) FILTER (WHERE l_orderkey % 3 = 0) AS pages FROM lineitem
UNION ALL SELECT 'div.review', count(*) FILTER (WHERE l_orderkey % 3 = 1) * 2, count(*) FILTER (WHERE l_orderkey % 3 = 1) FROM lineitem
UNION ALL SELECT 'div[id^="customer_review-"]', count(*) FILTER (WHERE l_orderkey % 3 <> 1), count(*) FILTER (WHERE l_orderkey % 3 <> 1) FROM lineitem
UNION ALL SELECT 'span[data-hook="review-body"]', count(*) FILTER (WHERE l_orderkey % 3 <> 1), count(*) FILTER (WHERE l_orderkey % 3 <> 1) FROM lineitem
UNION ALL SELECT 'div.a-section.review', count(*) FILTER (WHERE l_orderkey % 3 = 1), count(*) FILTER (WHERE l_orderkey % 3 = 1) FROM lineitem""")
def review_selector_audit(spark, sf):
    return extract_review.selector_audit(markup.review_pages(spark, sf))


# ---- search pages ---------------------------------------------------------------------------------
_K = "o_orderkey"
_SEARCH_FIRST = f"""
SELECT {_A.format(_K)} AS asin, 'kitchen word' || CAST({_K} % 40 AS VARCHAR) AS search_keyword, ({_K} // 40) * 48 + 1 AS search_rank,
 CASE {_K} % 4 WHEN 0 THEN CASE WHEN length('Title of item ' || {_K}) > 15 THEN 'Title of item ' || {_K} ELSE 'Title of item ' || {_K} END
  WHEN 1 THEN CASE WHEN length('Title of item ' || {_K} || ' long') > 15 THEN 'Title of item ' || {_K} || ' long' END
  WHEN 2 THEN 'T' || {_K} ELSE 'Label ' || {_K} END AS title,
 CASE WHEN {_K} % 4 < 3 THEN 'Maker' || o_custkey ELSE '' END AS brand,
 CASE {_K} % 3 WHEN 0 THEN '$' || {_K} % 90 || '.99' WHEN 1 THEN '$' || {_K} % 90 ELSE '' END AS price_shown,
 CASE {_K} % 3 WHEN 0 THEN '$1,499.00' WHEN 1 THEN '$5.00' ELSE '' END AS original_price,
 CASE {_K} % 3 WHEN 0 THEN ({_K} % 50) / 10.0 WHEN 1 THEN {_K} % 5 END AS rating,
 CAST(CASE {_K} % 4 WHEN 0 THEN ({_K} % 9 + 1) * 1000 + {_K} % 1000 WHEN 1 THEN {_K} % 700 WHEN 2 THEN 1000 + {_K} % 1000 END AS BIGINT) AS rating_count,
 CAST({_K} % 4 IN (0, 1) AS INT) AS is_sponsored, CAST({_K} % 3 = 0 AS INT) AS is_amazon_choice, CAST({_K} % 3 = 1 AS INT) AS is_best_seller,
 'https://www.amazon.com/dp/' || {_A.format(_K)} AS url, 'https://i.example/' || {_K} || '.jpg' AS image_url FROM orders"""
_SEARCH = f"""
WITH one AS ({_SEARCH_FIRST.replace('price_shown', 'price')})
SELECT * FROM one
UNION ALL
SELECT 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), 'kitchen word' || CAST({_K} % 40 AS VARCHAR), ({_K} // 40) * 48 + 3, 'Second', '', '', '', NULL, NULL, 0, 0, 0,
 'https://www.amazon.com/dp/C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), '' FROM orders"""


@query("search_items", _SEARCH)
def search_items(spark, sf):
    got = extract_search.search_items(extract_search.search_candidates(markup.search_pages(spark, sf)))
    got = got.drop("page_id", "page_kind", "keyword_ord", "page_no", "fetched_at", "pos")
    return got.withColumn("rating", F.round("rating", 2))


@query("search_items_brand_v1", f"""
SELECT {_A.format(_K)} AS asin, {_K} AS page_id, CASE {_K} % 4 WHEN 0 THEN 'Maker' || o_custkey WHEN 1 THEN 'prime deal' WHEN 2 THEN 'Maker' || o_custkey ELSE 'Adidas' END AS brand FROM orders
UNION ALL SELECT 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), {_K}, '' FROM orders""")
def search_items_brand_v1(spark, sf):
    found = extract_search.search_candidates(markup.search_pages(spark, sf))
    return extract_search.search_items(found, brand_rule="v1").select("asin", "page_id", "brand")


@query("search_pages_have_next", f"SELECT {_K} AS page_id, CAST({_K} % 400 <> 399 AS INT) AS has_next FROM orders")
def search_pages_have_next(spark, sf):
    got = extract_search.search_candidates(markup.search_pages(spark, sf))
    return got.select("page_id", F.col("has_next").cast("int").alias("has_next"))


# ---- product pages --------------------------------------------------------------------------------
_P = "p_partkey"
_BOUGHT = f"""CASE {_P} % 5 WHEN 0 THEN {_P} % 90 || 'K+ bought' WHEN 1 THEN {_P} % 90 || '+bought' WHEN 2 THEN {_P} % 90 || 'M+ bought in past month'
 WHEN 3 THEN {_P} % 90 || 'k+ Bought  in past month' ELSE '' END"""
_BOUGHT_N = f"CAST(CASE {_P} % 5 WHEN 0 THEN {_P} % 90 * 1000 WHEN 1 THEN {_P} % 90 WHEN 2 THEN {_P} % 90 * 1000000 WHEN 3 THEN {_P} % 90 * 1000 ELSE 0 END AS BIGINT)"


@query("product_details", f"""
SELECT {_A.format(_P)} AS asin, p_name || ' no ' || {_P} AS title, CASE WHEN {_P} % 3 < 2 THEN p_brand ELSE '' END AS brand,
 CASE WHEN {_P} % 6 < 5 THEN '$' || {_P} % 900 || '.99' ELSE '' END AS price,
 CASE {_P} % 3 WHEN 0 THEN '$1,499.00' WHEN 1 THEN '$99.00' ELSE '' END AS original_price,
 CAST(CASE {_P} % 4 WHEN 0 THEN ({_P} % 50) / 10.0 WHEN 1 THEN {_P} % 5 WHEN 2 THEN {_P} % 5 END AS DOUBLE) AS rating,
 CASE WHEN {_P} % 9 = 0 THEN NULL ELSE 1000 + {_P} % 1000 END AS rating_count,
 CAST(CASE WHEN {_P} % 4 < 3 THEN {_P} % 100 ELSE 0 END AS INT) AS rating_5_star, CAST(0 AS INT) AS rating_4_star, CAST(CASE WHEN {_P} % 4 < 3 THEN {_P} % 50 ELSE 0 END AS INT) AS rating_1_star,
 {_BOUGHT} AS bought_count, {_BOUGHT_N} AS bought_count_number,
 CASE {_P} % 4 WHEN 0 THEN 1000 + {_P} % 1000 WHEN 1 THEN {_P} % 500 + 1 WHEN 2 THEN {_P} % 500 + 1 END AS bsr_rank,
 CASE {_P} % 4 WHEN 0 THEN 'Kitchen' WHEN 1 THEN p_type WHEN 2 THEN 'Home & Garden' ELSE '' END AS bsr_category,
 CASE {_P} % 4 WHEN 0 THEN {_P} % 30 + 1 || ' Knives /gp/bestsellers/a|7 Blocks /gp/bestsellers/c' ELSE '' END AS sub_ranks,
 CASE {_P} % 3 WHEN 0 THEN p_name || ' one|' || p_name || 'two'
  WHEN 1 THEN list_aggregate(list_transform(range(1, 11), lambda n: 'point ' || n || ' of ' || {_P}), 'string_agg', '|') ELSE '' END AS bullets,
 CASE {_P} % 4 WHEN 0 THEN p_name || ' text' WHEN 1 THEN substr(repeat(p_name || ';', 300), 1, 2000) WHEN 2 THEN 'Soft &' || p_type ELSE '' END AS description,
 CASE {_P} % 4 WHEN 0 THEN 'https://i.example/' || {_P} || '._SL1500_.jpg|https://i.example/h_AC_SL1500_.jpg'
  WHEN 1 THEN 'https://i.example/' || {_P} || '.png|https://i.example/two.png' ELSE '' END AS images,
 CASE {_P} % 2 WHEN 0 THEN 'V' || {_P} || ' Red true|W' || {_P} || ' Largeset false' ELSE '' END AS variants,
 CASE {_P} % 3 WHEN 0 THEN 'Seller ' || p_size WHEN 1 THEN 'Amazon.com' ELSE '' END AS seller,
 CAST({_P} % 4 < 2 AS INT) AS is_fba, CAST({_P} % 2 = 0 AS INT) AS has_aplus,
 CASE {_P} % 4 WHEN 0 THEN 'March ' || {_P} % 28 + 1 || ', 2024' WHEN 1 THEN 'May ' || {_P} % 28 + 1 || ' 2023' ELSE '' END AS first_available,
 CASE {_P} % 2 WHEN 0 THEN 'In Stock' ELSE '' END AS availability
FROM part WHERE {_P} % 37 <> 0""".replace(f"'March ' || {_P} % 28 + 1", f"'March ' || ({_P} % 28 + 1)").replace(
    f"'May ' || {_P} % 28 + 1", f"'May ' || ({_P} % 28 + 1)").replace(f"THEN {_P} % 30 + 1 || ' K", f"THEN ({_P} % 30 + 1) || ' K"))
def product_details(spark, sf):
    got = extract_product.with_star_columns(extract_product.products(markup.product_pages(spark, sf)))
    ranks = F.transform("sub_category_ranks", lambda r: F.concat_ws(" ", r.rank, r.category, r.url))
    variants = F.transform("variants", lambda v: F.concat_ws(" ", v.asin, v.value, v.available.cast("string")))
    return got.select(
        "asin", "title", "brand", "price", "original_price", F.round("rating", 2).alias("rating"), "rating_count",
        "rating_5_star", "rating_4_star", "rating_1_star", "bought_count", "bought_count_number", "bsr_rank", "bsr_category",
        F.array_join(ranks, "|").alias("sub_ranks"), F.array_join("bullet_points", "|").alias("bullets"), "description",
        F.array_join("images", "|").alias("images"), F.array_join(variants, "|").alias("variants"), "seller", "is_fba",
        "has_aplus", "first_available", "availability",
    )


# ---- review pages ---------------------------------------------------------------------------------
_L = "l_orderkey"
_REVIEWS = f"""
SELECT {_A.format('l_partkey')} AS asin, 'R' || {_L} || 'x' || l_linenumber AS review_id,
 CASE {_L} % 3 WHEN 0 THEN 'Good ' || {_L} WHEN 1 THEN 'Fine ' || {_L} ELSE '' END AS title, 'Works for ' || {_L} AS content,
 CAST(CASE {_L} % 3 WHEN 0 THEN 4 WHEN 1 THEN CAST(l_quantity AS INT) % 5 + 1 ELSE 0 END AS INT) AS rating, strftime(l_shipdate, '%B %-d, %Y') AS date,
 strftime(l_shipdate, '%Y-%m-%d') AS review_date, CAST(l_linestatus = 'F' AS INT) AS verified_purchase, CAST({_L} % 80 AS INT) AS helpful_votes,
 'Ann ' || l_suppkey AS author, 'Size: ' || l_linenumber AS variant FROM lineitem
UNION ALL
SELECT {_A.format('l_partkey')}, substr(md5('plain ' || {_L} || chr(10) || ' text'), 1, 12), '', '', 0, '', NULL, 0, 0, '', '' FROM lineitem WHERE {_L} % 3 < 2"""


@query("review_rows", _REVIEWS)
def review_rows(spark, sf):
    got = extract_review.reviews(markup.review_pages(spark, sf)).drop("page_id", "page_kind", "page_no", "fetched_at", "pos")
    return got.withColumn("review_date", F.date_format("review_date", "yyyy-MM-dd"))


@query("review_rows_with_brand", f"""
SELECT asin, review_id, 'Acme' AS brand FROM ({_REVIEWS})""")
def review_rows_with_brand(spark, sf):
    got = extract_review.reviews(markup.review_pages(spark, sf))
    return got.select("asin", "review_id", F.lit("Acme").alias("brand"))
