"""One broken item, one broken page: the others stay, and the faults are told."""

import pytest
from pyspark.sql import functions as F

from shelfscope.plans import jobs
from shelfscope.sources.pages import with_context
from shelfscope.sources.tables import Store

BROKEN = "&#" + "9" * 5000 + ";"
ITEM = '<div data-component-type="s-search-result" data-asin="{asin}"><h2><span>{title}</span></h2></div>'
REVIEW = '<div data-hook="review" id="customer_review-{id}"><span data-hook="review-body"><span>{said}</span></span></div>'


def pages_of(spark, *rows):
    return with_context(spark.createDataFrame([(n, url, html) for n, (url, html) in enumerate(rows)], "page_id long, url string, html string"))


def listed(*titles):
    return "".join(ITEM.format(asin=f"B{n:09d}", title=t) for n, t in enumerate(titles))


def maps(df):
    """How often the optimized plan parses pages."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_a_broken_item_leaves_the_others(spark, folder):
    html = listed("First of all titles", f"Second {BROKEN} title", "Third of all titles") + '<a class="s-pagination-next" href="#">Next</a>'
    pages = pages_of(spark, ("https://www.amazon.com/s?k=knife&page=1", html), ("https://www.amazon.com/s?k=knife&page=2", f"<p>{BROKEN}</p>"))
    store = Store(spark, f"{folder}/store").create()
    found = jobs.run_search(pages, store, folder, jobs.Settings())
    assert sorted((r.asin, r.search_rank) for r in found.collect()) == [("B000000000", 1), ("B000000002", 3)]
    faults = spark.read.parquet(f"{folder}/search_faults").collect()
    assert sorted(((r.page_no, r.search_keyword, r.pos, r.kind) for r in faults), key=str) == [(1, "knife", 1, "BrokenText"), (2, "knife", None, "page")]
    assert [tuple(r) for r in spark.read.json(f"{folder}/search_outcome").select("kept", "rejected", "faults").collect()] == [(2, 0, 2)]


def test_an_attribute_can_be_broken_too(spark):
    html = listed("First of all titles") + ITEM.format(asin=f"B{BROKEN}", title="Second of all titles")
    pages = pages_of(spark, ("https://www.amazon.com/s?k=knife&page=1", html))
    rows = jobs.search_rows(pages, jobs.Settings())
    assert [(r.asin, [tuple(f) for f in r.faults]) for r in rows.collect()] == [("B000000000", [(1, "BrokenText")])]


def test_a_broken_review_leaves_the_others(spark, folder):
    html = REVIEW.format(id="R1", said="Good") + REVIEW.format(id="R2", said=BROKEN) + REVIEW.format(id="R3", said="Bad")
    pages = pages_of(spark, ("https://www.amazon.com/product-reviews/B000000001/?pageNumber=1", html), ("https://www.amazon.com/product-reviews/B000000002/?pageNumber=1", BROKEN))
    store = Store(spark, f"{folder}/store").create()
    asins = spark.createDataFrame([("B000000001",), ("B000000002",), ("B000000003",)], "asin string")
    found = jobs.run_reviews(pages, store, folder, jobs.Settings(), asins=asins)
    assert sorted(r.review_id for r in found.collect()) == ["R1", "R3"]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/review_outcomes").collect()) == [("B000000001", True), ("B000000002", False), ("B000000003", False)]
    faults = spark.read.parquet(f"{folder}/review_faults").select("asin", "pos", "kind").collect()
    assert sorted((tuple(r) for r in faults), key=str) == [("B000000001", 1, "BrokenText"), ("B000000002", None, "page")]


def test_an_apology_in_a_listing_is_no_refusal(spark):
    sorry = "<title>Amazon.com: sorry game</title>"
    rows = [(f"https://www.amazon.com/s?k=sorry&page={n}", sorry + listed(f"We're Sorry: an apology novel {n}") + '<a class="s-pagination-next" href="#">Next</a>') for n in (1, 2, 3)]
    rows.append(("https://www.amazon.com/s?k=sorry&page=4", "<title>Sorry! Something went wrong!</title>"))
    got = jobs.search_listings(pages_of(spark, *rows).withColumn("keyword", F.col("keyword")), jobs.Settings()).collect()
    assert len(got) == 1 and jobs.search_rows(pages_of(spark, *rows), jobs.Settings()).where("asin IS NOT NULL").count() == 3


@pytest.mark.parametrize("job", ["search", "products", "reviews"])
def test_pages_are_parsed_once(spark, job):
    pages = pages_of(spark, ("https://www.amazon.com/s?k=knife&page=1", listed("First of all titles")))
    plans = {
        "search": lambda: jobs.search_listings(pages, jobs.Settings()),
        "products": lambda: jobs.product_details(pages, jobs.Settings()),
        "reviews": lambda: jobs.newest_page(jobs.review_page_candidates(pages, 10), ["asin", "page_no"], bad="bad"),
    }
    assert maps(plans[job]()) == 1


def test_an_upsert_reads_its_input_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).selectExpr("concat('B', id % 60) AS asin", "if(id % 3 = 0, null, 'b') AS brand")
    Store(spark, folder).create()["products"].upsert(rows.mapInArrow(count, rows.schema))
    assert seen.value == 100
