"""Pages that cannot be used, among pages that can: the jobs keep all the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import base, spread
from shelfscope.plans import jobs
from shelfscope.session import scratch_path
from shelfscope.sources.pages import with_context
from shelfscope.sources.tables import KeyedTable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CAPTCHA = '<form action="/errors/validateCaptcha"></form>'
REVIEW = (
    '<div data-hook="review" id="customer_review-R{n}"><span class="a-profile-name">Ann</span>'
    '<span data-hook="review-body"><span>{said}</span></span></div>'
)


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


def _text(form: str, **parts):
    """``form`` with columns in the places of its names."""
    out, rest = [], form
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


@query("reviews_that_say_sorry", """
SELECT printf('B%09d', o_custkey) AS asin, 'R' || o_orderkey AS review_id FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 10""")
def reviews_that_say_sorry(spark, sf):
    """Each order is a review page of its customer; every third quotes an apology, every second also has a later captcha copy."""
    orders = base(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Support said: we're sorry")).otherwise(F.lit("Works well"))
    url = F.format_string("https://www.amazon.com/product-reviews/B%09d/ref=x?pageNumber=%d", "o_custkey", "n")
    good = orders.select((F.col("o_orderkey") * 2).alias("page_id"), url.alias("url"), _text(REVIEW, n=F.col("o_orderkey"), said=said).alias("html"))
    refused = orders.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") * 2 + 1).alias("page_id"), url.alias("url"), F.lit(CAPTCHA).alias("html"))
    pages = with_context(good.unionByName(refused))
    return jobs.reviews_of_candidates(jobs.review_page_candidates(pages, 10), 10).select("asin", "review_id")


@query("search_past_refused_pages", """
SELECT printf('B%09d', o_orderkey) AS asin, o_custkey || '%off' AS search_keyword, cast((n - 1) * 48 + 1 AS BIGINT) AS search_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n % 3 <> 2""")
def search_past_refused_pages(spark, sf):
    """Each order is a search page of its customer's keyword, which is no valid encoding; every third page is a captcha or a broken
    page, and every other good page also has a later captcha copy."""
    orders = base(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n")
    item = _text('<div data-component-type="s-search-result" data-asin="{asin}"><h2><span>Some title of it</span></h2></div><a class="s-pagination-next" href="#">Next</a>', asin=F.format_string("B%09d", "o_orderkey"))
    broken = F.concat(F.lit("<p>&#"), F.repeat(F.lit("9"), 5000), F.lit(";</p>"))
    html = F.when(F.col("n") % 3 != 2, item).when(F.col("n") % 2 == 0, F.lit(CAPTCHA)).otherwise(broken)
    url = F.format_string("https://www.amazon.com/s?k=%d%%off&page=%d", "o_custkey", "n")
    pages = orders.select((F.col("o_orderkey") * 2).alias("page_id"), url.alias("url"), html.alias("html"))
    later = orders.where("n % 3 <> 2 AND o_orderkey % 2 = 0").select((F.col("o_orderkey") * 2 + 1).alias("page_id"), url.alias("url"), F.lit(CAPTCHA).alias("html"))
    found = jobs.search_listings(with_context(pages.unionByName(later)), jobs.Settings())
    return found.select("asin", "search_keyword", "search_rank")


@query("upsert_repeated_keys", """
SELECT s, printf('B%09d', l_partkey) AS asin, max(l_linenumber) AS title, count(DISTINCT l_partkey) AS n FROM lineitem, (VALUES ('one part'), ('two parts')) t(s)
GROUP BY s, l_partkey""")
def upsert_repeated_keys(spark, sf):
    """A batch that repeats keys leaves one row of each, read after one part and after several; the highest line counts."""
    lines = base(spark, sf, "lineitem").select(F.format_string("B%09d", "l_partkey").alias("asin"), F.lit("b").alias("brand"), F.col("l_linenumber").cast("string").alias("title"), F.col("l_linenumber").alias("seq"))
    table = KeyedTable(spark, scratch_path(spark, "repeated"), "products").create()

    def seen(name):
        rows = table.read().where("asin <> 'other'")
        return rows.groupBy("asin").agg(F.max(F.col("title").cast("int")).alias("title"), F.count("*").alias("n")).select(F.lit(name).alias("s"), "asin", "title", "n")

    table.upsert(lines)
    first = seen("one part")
    table.upsert(spark.createDataFrame([("other", "b")], "asin string, brand string"))
    return first.unionByName(seen("two parts"))


@query("older_part_reads_defaults", """
SELECT printf('B%09d', p_partkey) AS asin, p_name AS title, '' AS bought_count, 0 AS bought_count_number FROM part""")
def older_part_reads_defaults(spark, sf):
    """Files written before two columns were added, taken up as a table, and a row with them for a single other key."""
    path = scratch_path(spark, "older")
    table = KeyedTable(spark, path, "products")
    old = base(spark, sf, "part").select(F.format_string("B%09d", "p_partkey").alias("asin"), F.lit("b").alias("brand"), F.col("p_name").alias("title"))
    old.write.parquet(f"{path}/old")
    table.migrate_from(spark.read.parquet(f"{path}/old"))
    table.upsert(spark.createDataFrame([("other", "b")], "asin string, brand string"))
    return table.read().where("asin <> 'other'").select("asin", "title", "bought_count", "bought_count_number")


@query("search_past_broken_items", """
SELECT printf('B%09d', o_orderkey) AS asin, CAST(1 AS BIGINT) AS search_rank, NULL AS fault FROM orders
UNION ALL SELECT printf('C%09d', o_orderkey), CAST(3 AS BIGINT), NULL FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, '1:BrokenText' FROM orders""")
def search_past_broken_items(spark, sf):
    """Each order is the one page of a keyword that lists three items under an apology; the second holds a number that is no character."""
    item = '<div data-component-type="s-search-result" data-asin="{asin}"><h2><span>{title}</span></h2></div>'
    orders = spread(base(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    broken = F.concat(F.lit("<p>&#"), F.repeat(F.lit("9"), 5000), F.lit(";</p>"))
    html = F.concat(
        F.lit("<title>Amazon.com : sorry</title>"),
        _text(item, asin=F.format_string("B%09d", "o_orderkey"), title=F.lit("We're Sorry: a novel of apologies")),
        _text(item, asin=F.format_string("X%09d", "o_orderkey"), title=broken),
        _text(item, asin=F.format_string("C%09d", "o_orderkey"), title=F.lit("Sorry! Something went wrong, a game")),
    )
    url = F.format_string("https://www.amazon.com/s?k=%d&page=1", "o_orderkey")
    rows = jobs.stage(jobs.search_rows(with_context(orders.select(F.col("o_orderkey").alias("page_id"), url.alias("url"), html.alias("html"))), jobs.Settings()))
    items = rows.where("asin IS NOT NULL").select("asin", "search_rank", F.lit(None).cast("string").alias("fault"))
    faults = jobs.fault_rows(rows, ["search_keyword"])
    return items.unionByName(faults.select(F.col("search_keyword").alias("asin"), F.lit(None).cast("bigint").alias("search_rank"), F.concat_ws(":", "pos", "kind").alias("fault")))
