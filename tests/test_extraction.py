"""Hand-written pages with the records they must give."""

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import extract_product, extract_review, extract_search

SEARCH = """
<div data-component-type="s-search-result" data-asin="B0TEST0001"><img class="s-image" src="https://i.example/1.jpg"><span class="a-badge-text">Best Seller</span><h5 class="s-line-clamp-1"><a href="/s?k=acme">Visit the Acme Store</a></h5><h2><a class="a-link-normal"><span class="a-text-normal">Acme Chef Knife 8 inch Steel</span></a></h2><span class="a-price"><span class="a-offscreen">$1,299.00</span></span><span class="a-price a-text-price"><span class="a-offscreen">$1,499.00</span></span><i class="a-icon-star-small"><span class="a-icon-alt">4.5 out of 5 stars</span></i><span class="a-size-base s-underline-text">(2,345)</span></div>
<div data-component-type="s-search-result" data-asin="SHORT"></div>
<div data-component-type="s-search-result" data-asin="B0TEST0002"><h2><span>Plain</span></h2><span>Sponsored</span></div>
<a class="s-pagination-next s-pagination-disabled">Next</a>
"""
PRODUCT = """
<span id="productTitle"> Acme Chef Knife </span><a id="bylineInfo">Brand: Acme</a><div id="corePrice_feature_div"><span class="a-offscreen">$29.99</span></div><span id="acrPopover" title="4.3 out of 5 stars"></span><span id="acrCustomerReviewText">1,234 ratings</span>
<table id="histogramTable"><tr><td><a>5 star</a></td><td>bar</td><td><a>70%</a></td></tr><tr><td><a>1 star</a></td><td>bar</td><td><a>5%</a></td></tr></table>
<div id="social-proofing-faceout-title-tk_bought"><span class="a-text-bold">2K+ bought</span> in past month</div>
<ul id="detailBullets_feature_div"><li>Best Sellers Rank: #1,234 in Kitchen (See Top 100)</li><li>Date First Available : March 5, 2024</li></ul>
<div id="feature-bullets"><ul><li><span class="a-list-item">Sharp steel blade</span></li><li><span class="a-list-item">Tiny</span></li><li><span class="a-list-item">Sharp steel blade</span></li></ul></div>
<div id="productDescription"><p></p></div><div id="altImages"><img src="https://i.example/a._SS40_.jpg"><img src="https://i.example/grey-pixel.gif"></div><div id="availability"><span> In Stock </span></div><i class="a-icon-prime"></i>
"""
REVIEWS = """
<div data-hook="review" id="customer_review-R1"><span class="a-profile-name">Ann</span><i data-hook="review-star-rating"><span class="a-icon-alt">4.0 out of 5 stars</span></i><a data-hook="review-title"><span class="a-size-base">x</span><span>Great knife</span></a><span data-hook="review-date">Reviewed in the United States on March 5, 2024</span><span data-hook="avp-badge">Verified</span><span data-hook="review-body"><span>Cuts well.</span></span><span data-hook="helpful-vote-statement">12 people found this helpful</span></div>
<div data-hook="review"><span data-hook="review-body">No id here</span><span data-hook="helpful-vote-statement">One person found this helpful</span></div>
"""


def search_page(spark, html):
    return spark.createDataFrame([(html, "knife", 2)], "html string, keyword string, page_no int")


def product(spark, html):
    rows = extract_product.products(spark.createDataFrame([(html, "B0TEST0001")], "html string, asin string"))
    return extract_product.with_star_columns(rows).collect()


def test_search_page(spark):
    page = extract_search.search_candidates(search_page(spark, SEARCH))
    assert page.select("has_next").collect()[0][0] is False
    first, second = extract_search.search_items(page).orderBy("pos").collect()
    assert first.asDict() == {
        "page_no": 2, "pos": 0, "asin": "B0TEST0001", "search_keyword": "knife", "search_rank": 49,
        "title": "Acme Chef Knife 8 inch Steel", "brand": "Acme", "price": "$1,299.00", "original_price": "$1,499.00",
        "rating": 4.5, "rating_count": 2345, "is_sponsored": 0, "is_amazon_choice": 0, "is_best_seller": 1,
        "url": "https://www.amazon.com/dp/B0TEST0001", "image_url": "https://i.example/1.jpg",
    }
    assert (second.asin, second.search_rank, second.title, second.brand, second.price) == ("B0TEST0002", 51, "Plain", "", "")
    assert (second.rating, second.rating_count, second.is_sponsored) == (None, None, 1)


def test_search_layout_fallback_is_page_wide(spark):
    html = '<div class="s-result-item" data-asin="B0TEST0009"></div><a class="s-pagination-next">n</a>'
    page = extract_search.search_candidates(search_page(spark, html))
    assert page.select("has_next").collect()[0][0] is True
    assert [r.asin for r in extract_search.search_items(page).collect()] == ["B0TEST0009"]


def test_product_page(spark):
    (row,) = product(spark, PRODUCT)
    assert row.asDict(True) == {
        "asin": "B0TEST0001", "title": "Acme Chef Knife", "brand": "Acme", "price": "$29.99", "original_price": "",
        "rating": 4.3, "rating_count": 1234, "bought_count": "2K+ bought", "bought_count_number": 2000, "bsr_rank": 1234,
        "bsr_category": "Kitchen", "sub_category_ranks": [], "bullet_points": ["Sharp steel blade"], "description": "",
        "images": ["https://i.example/a._SL1500_.jpg"], "variants": [], "seller": "", "is_fba": 1, "has_aplus": 0,
        "first_available": "March 5, 2024", "availability": "In Stock", "rating_5_star": 70, "rating_4_star": 0,
        "rating_3_star": 0, "rating_2_star": 0, "rating_1_star": 5,
    }


def test_page_without_title_gives_no_product(spark):
    assert product(spark, "<p>Robot Check</p>") == []


def test_matched_but_empty_text_ends_a_first_match_chain(spark):
    html = '<span id="productTitle"></span><h1 class="a-size-large">Later</h1>'
    assert product(spark, html) == []
    price = '<span id="productTitle">T</span><span id="priceblock_ourprice"> </span><span id="priceblock_dealprice">$1</span>'
    assert product(spark, price)[0].price == ""


def test_review_page(spark):
    rows = spark.createDataFrame([(REVIEWS, "B0TEST0001")], "html string, asin string")
    first, second = extract_review.reviews(rows).orderBy("pos").collect()
    assert (first.review_id, first.title, first.content, first.rating, first.date) == ("R1", "Great knife", "Cuts well.", 4, "March 5, 2024")
    assert (first.verified_purchase, first.helpful_votes, first.author, str(first.review_date)) == (1, 12, "Ann", "2024-03-05")
    assert (second.review_id, second.title, second.content, second.rating) == ("468e61c981eb", "", "No id here", 0)
    assert (second.date, second.verified_purchase, second.helpful_votes, second.author) == ("", 0, 1, "")


@pytest.mark.parametrize("html", [None, "", "plain text", "<![bad[", "<div data-hook='review'"])
def test_broken_pages_do_not_fail_the_job(spark, html):
    rows = spark.createDataFrame([(html, "A"), (REVIEWS, "B")], "html string, asin string")
    got = extract_review.review_candidates(rows)
    assert extract_review.review_rows(got).where("asin = 'B'").count() == 2
    assert extract_search.search_candidates(search_page(spark, html)).count() == 1


def test_extraction_does_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(REVIEWS, f"B{n}") for n in range(40)], "html string, asin string")
    one = extract_review.reviews(rows.coalesce(1))
    many = extract_review.reviews(rows.repartition(7, "asin"))
    assert one.exceptAll(many).isEmpty() and one.count() == many.count() == 80


def test_html_never_leaves_the_scan_stage(spark):
    rows = spark.createDataFrame([(REVIEWS, "B")], "html string, asin string")
    plan = extract_review.reviews(rows).groupBy("asin").count()._jdf.queryExecution().executedPlan().toString()
    below_exchange = plan[plan.index("Exchange"):]
    assert "MapInArrow" in below_exchange and plan.count("Exchange") == 1
