"""Marketplace pages rendered by Spark from the tables, one page per row, in several page layouts.

The layout of each field follows from the row's key, so an oracle can state, from the table alone, what
extraction must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.views import base, spread

ASIN = "concat('B', lpad(cast({0} AS string), 9, '0'))"


def _html(*pieces: str) -> Column:
    return F.concat(*[F.expr(p) for p in pieces])


def _pick(key: str, forms: list[str], every: int | None = None) -> str:
    """SQL: the form the key picks; keys past the last form give ''."""
    cases = " ".join(f"WHEN {n} THEN {form}" for n, form in enumerate(forms))
    return f"CASE {key} % {every or len(forms)} {cases} ELSE '' END"


def product_pages(spark, sf: str) -> DataFrame:
    part = spread(base(spark, sf, "part"), "p_partkey")
    k, name = "p_partkey", "concat(p_name, ' no ', p_partkey)"
    price = f"concat('$', {k} % 900, '.99')"
    stars = [
        f"""concat('<table id="histogramTable"><tr><td class="a-text-right"><a>5 star</a></td><td>bar</td><td><a>', {k} % 100, '%</a></td></tr>"""
        f"""<tr><td><a>1 star</a></td><td>bar</td><td><a>1%</a></td></tr><tr><td><a>1 star</a></td><td>bar</td><td><a>', {k} % 50, '%</a></td></tr></table>')""",
        f"""concat('<div id="reviewsMedley"><a href="/r?filterByStar=five" aria-label="', {k} % 100, '% x"></a>"""
        f"""<a href="/r?filterByStar=five" title="5 stars represent ', {k} % 100, '% of rating"></a>"""
        f"""<a href="/r?filterByStar=one" aria-label="1 STAR is ', {k} % 50, '%"></a></div>')""",
        f"""concat('<div class="a-histogram-row"><span>5 star ', {k} % 100, '%</span></div><div class="histogram-x"><div class="row-y"><a>1 Star', {k} % 50, '%</a></div></div>')""",
    ]
    bought = [
        f"""concat('<div id="social-proofing-faceout-title-tk_bought"><span class="a-text-bold">', {k} % 90, 'K+ bought</span><span> in past month</span></div>')""",
        f"""concat('<div class="social-proofing-faceout-title-container"><b>', {k} % 90, '+</b> <b>bought</b></div>')""",
        f"""concat('<p><span>', {k} % 90, 'M+ bought in past month</span></p>')""",
        f"""concat('<p><b>', {k} % 90, 'k+ Bought  in past month</b></p>')""",
    ]
    ranks = [
        f"""concat('<table id="productDetails_detailBullets_sections1"><tr><th>Best Sellers Rank</th><td><span>#1,', lpad(cast({k} % 1000 AS string), 3, '0'), ' in Kitchen (See Top 100)</span>"""
        f"""<span>#', {k} % 30 + 1, ' in <a href="/gp/bestsellers/a">Knives</a></span><span>#', {k} % 30 + 1, ' in <a href="/gp/bestsellers/b">Knives</a></span>"""
        f"""<span>#7 in <a href="/gp/bestsellers/c">Blocks</a></span></td></tr><tr><td>Date First Available</td> <td>March ', {k} % 28 + 1, ', 2024</td></tr></table>')""",
        f"""concat('<ul id="detailBullets_feature_div"><li>Weight: 3 in total</li><li>Best Sellers Rank: #', {k} % 500 + 1, ' in ', p_type, '\n (more)</li>"""
        f"""<li><b>Date First Available</b> : May ', {k} % 28 + 1, ' 2023</li></ul>')""",
        f"""concat('<table class="prodDetTable"><tr><td>Amazon Best Sellers Rank</td><td>', {k} % 500 + 1, ' in Home &amp; Garden (x)</td></tr></table>')""",
    ]
    bullets = [
        f"""concat('<div id="feature-bullets"><ul><li class="aok-hidden"><span class="a-list-item">hidden point</span></li><li><span class="a-list-item">', p_name, ' one</span></li>"""
        f"""<li><span class="a-list-item">tiny</span></li><li><span class="a-list-item">', p_name, ' one</span></li><li><span class="a-list-item">', p_name, ' <i>two</i></span></li></ul></div>')""",
        f"""concat('<div id="feature-bullets"><ul>', array_join(transform(sequence(1, 12), n -> concat('<li><span>point ', n, ' of ', {k}, '</span></li>')), ''), '</ul></div>')""",
    ]
    images = [
        f"""concat('<div id="altImages"><img src="https://i.example/', {k}, '._SS40_.jpg"><img src="https://i.example/grey-pixel.gif"><img src="" data-old-hires="https://i.example/h_AC_US40_.jpg"/></div>"""
        f"""<ul><li class="image item"><img src="https://i.example/', {k}, '._SS40_.jpg"></li></ul>')""",
        f"""concat('<div id="imageBlock"><img src="x-sprite.png"></div><img id="landingImage" data-a-dynamic-image="{{&quot;https://i.example/', {k}, '.png&quot;:[5,5],&quot;https://i.example/two.png&quot;:[1,1]}}">')""",
        """'<img id="imgBlkFront" data-a-dynamic-image="{broken">'""",
    ]
    variants = [
        f"""concat('<div id="twister"><ul><li data-defaultasin="V', {k}, '" title="Red"></li><li data-defaultasin="" title=""></li></ul></div>"""
        f"""<ul id="variation_size_name"><li class="swatch unavailable" data-asin="W', {k}, '"><b>Large</b> set</li></ul>')""",
        "''",
    ]
    html = _html(
        """'<!DOCTYPE html><html><head><title>Shop</title><script>var a = "<span id=productTitle>no</span>";</script></head><body><div id="dp">'""",
        f"CASE WHEN {k} % 37 = 0 THEN '' ELSE " + _pick(k, [
            f"""concat('<span id="productTitle" class="a-size-large">\n  ', {name}, ' </span>')""",
            f"""concat('<h1 id="title"><span>', {name}, '</span><span>Other</span></h1>')""",
            f"""concat('<h1 class="x a-size-large">', {name}, '<!-- c --><script>1</script></h1>')""",
        ]) + " END",
        _pick(k, [
            """concat('<a id="bylineInfo" href="/b">Visit the ', p_brand, ' Store</a>')""",
            """concat('<table><tr class="po-brand"><td>Brand</td><td><span class="a-size-base po-break-word">Brand: ', p_brand, '</span></td></tr></table>')""",
        ], 3),
        _pick(k, [
            f"""concat('<span class="a-price aok-align-center"><span class="a-offscreen">', {price}, '</span></span>')""",
            f"""concat('<div id="corePrice_feature_div"><div><span class="a-offscreen">', {price}, '</span></div></div>')""",
            f"""concat('<span id="priceblock_ourprice">', {price}, '</span>')""",
            f"""concat('<span id=priceblock_dealprice>', {price}, '</span>')""",
            f"""concat('<span class="a-price"><span class="a-offscreen">', {price}, '</span></span>')""",
        ], 6),
        _pick(k, ["""'<span class="a-text-strike">$1,499.00</span>'""", """'<span data-a-strike="true"><span class="a-offscreen">$99.00</span></span>'"""], 3),
        _pick(k, [
            f"""concat('<span id="acrPopover" title="', cast({k} % 50 / 10 AS decimal(3, 1)), ' out of 5 stars"></span>')""",
            f"""concat('<div id="averageCustomerReviews"><i><span class="a-icon-alt">', {k} % 5, ' out of 5</span></i></div>')""",
            f"""concat('<span id="acrPopover" title="4.5.1 out of 5"></span><div id="averageCustomerReviews"><span class="a-icon-alt">', {k} % 5, ' out of 5</span></div>')""",
        ], 4),
        f"""CASE WHEN {k} % 9 = 0 THEN '' ELSE concat('<span id="acrCustomerReviewText">1,', lpad(cast({k} % 1000 AS string), 3, '0'), ' ratings</span>') END""",
        _pick(k, stars, 4),
        _pick(k, bought, 5),
        _pick(k, ranks, 4),
        _pick(k, bullets, 3),
        _pick(k, [
            """concat('<div id="productDescription"><p></p>', p_name, ' text</div>')""",
            """concat('<div id="productDescription"><p>', repeat(concat(p_name, ';'), 300), '</p></div>')""",
            """concat('<div data-feature-name="productDescription">Soft &amp; <b>', p_type, '</b></div>')""",
        ], 4),
        _pick(k, images, 4),
        _pick(k, variants),
        _pick(k, [
            """concat('<a id="sellerProfileTriggerId"> Seller ', p_size, ' </a>')""",
            """'<div id="merchant-info"><a></a>Ships from and sold by Amazon.com.</div>'""",
        ], 3),
        _pick(k, ["""'<a id="SSOFpopoverLink">Fulfilled by AMAZON</a>'""", """'<i class="a-icon a-icon-prime"></i>'""", """'<div id="deliveryMessageMirId">by post</div>'"""], 4),
        _pick(k, ["""'<div class="aplus-v2 desktop"></div>'"""], 2),
        _pick(k, ["""'<div id="availability"><span>\n In Stock </span></div>'"""], 2),
        "'<p>open <b>to the end</div></body></html>'",
    )
    return part.select(
        F.col(k).alias("page_id"),
        F.expr(f"concat('https://www.amazon.com/dp/', {ASIN.format(k)})").alias("url"),
        html.alias("html"),
        F.lit("product").alias("page_kind"),
        F.expr(ASIN.format(k)).alias("asin"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("fetched_at"),
    )


def search_pages(spark, sf: str) -> DataFrame:
    """One page of up to four containers per order; 40 keywords, page numbers from the key."""
    orders = spread(base(spark, sf, "orders"), "o_orderkey")
    k = "o_orderkey"
    title = f"concat('Title of item ', {k})"
    first = _html(
        f"""concat('<div data-component-type="s-search-result" data-asin="', {ASIN.format(k)}, '"><img class="s-image" src="https://i.example/', {k}, '.jpg">')""",
        _pick(k, [
            """concat('<h5 class="s-line-clamp-1"><a href="/s?k=b">Visit the Maker', o_custkey, ' Store</a></h5>')""",
            """concat('<h5 class="s-line-clamp-1"><a href="/x">prime deal</a></h5><span class="a-size-base-plus a-color-base">Maker', o_custkey, '</span>')""",
            """concat('<div class="a-row a-size-base a-color-base"><a>Brand: Maker', o_custkey, '</a></div>')""",
            """'<a class="a-size-base a-link-normal">Adidas</a>'""",
        ]),
        _pick(k, [
            f"""concat('<h2><a class="a-link-normal"><span class="a-text-normal">', {title}, '</span></a></h2>')""",
            f"""concat('<h2><span>Title</span><span>of item</span><span></span><span>', {k}, ' long</span></h2>')""",
            f"""concat('<h2><span>T', {k}, '</span></h2>')""",
            f"""concat('<a class="a-link-normal" href="/x/dp/1" aria-label="Label ', {k}, '">go</a>')""",
        ]),
        _pick(k, [
            f"""concat('<span class="a-price"><span class="a-offscreen">$', {k} % 90, '.99</span></span>')""",
            f"""concat('<span class="a-price"><span class="a-offscreen">', {k} % 90, ' EUR</span></span><span class="a-color-price">$', {k} % 90, '</span>')""",
        ], 3),
        _pick(k, [
            """'<span class="a-price a-text-price"><span class="a-offscreen">$1,499.00</span></span>'""",
            """'<span data-a-strike="true"><span class="a-offscreen">$5.00</span></span>'""",
        ], 3),
        _pick(k, [
            f"""concat('<i class="a-icon a-icon-star-small"><span class="a-icon-alt">', cast({k} % 50 / 10 AS decimal(3, 1)), ' out of 5 stars</span></i>')""",
            f"""concat('<i class="a-icon-star-mini" aria-label="', {k} % 5, ' out of 5"></i>')""",
            f"""concat('<i class="a-icon-star"><span class="a-icon-alt">bad</span></i>')""",
        ]),
        _pick(k, [
            f"""concat('<span class="a-size-base s-underline-text">(', {k} % 9 + 1, ',', lpad(cast({k} % 1000 AS string), 3, '0'), ')</span>')""",
            f"""concat('<span class="a-size-base s-underline-text">4.5</span><a href="/p#customerReviews"><span class="a-size-base">', {k} % 700, '</span></a>')""",
            f"""concat('<a href="/p#customerReviews" aria-label="1,', lpad(cast({k} % 1000 AS string), 3, '0'), ' ratings">x</a>')""",
        ], 4),
        _pick(k, ["""'<span><span> SPONSORED </span></span>'""", """'<div class="s-ad-badge"></div>'""", """'<span>Sponsored by</span>'"""], 4),
        _pick(k, ["""'<span class="a-badge-text"><b>Overall</b> Amazon&#39;s Choice</span>'""", """'<span class="a-badge-label">#1 BEST SELLER</span>'"""], 3),
        "'</div>'",
    )
    html = F.concat(
        F.lit("<html><body><div class='s-main-slot'>"),
        first,
        F.expr(f"""concat('<div data-component-type="s-search-result" data-asin="SHORT"></div><div class="s-result-item" data-asin="B00000other"></div>')"""),
        F.expr(f"""concat('<div data-component-type="s-search-result" data-asin="{'{0}'}"><h2>Second', '</h2></div>')""".replace("{0}", "C', lpad(cast(o_custkey AS string), 9, '0'), '")),
        F.expr(f"""CASE WHEN {k} % 400 = 399 THEN '<a class="s-pagination-next s-pagination-disabled">Next</a>' ELSE '<a class="s-pagination-item s-pagination-next" href="/n">Next</a>' END"""),
        F.lit("</div></body></html>"),
    )
    return orders.select(
        F.col(k).alias("page_id"),
        F.expr(f"concat('https://www.amazon.com/s?k=kitchen+word', {k} % 40, '&page=', {k} div 40 + 1)").alias("url"),
        html.alias("html"),
        F.lit("search").alias("page_kind"),
        F.expr(f"concat('kitchen word', {k} % 40)").alias("keyword"),
        F.expr(f"cast({k} % 40 AS int)").alias("keyword_ord"),
        F.expr(f"cast({k} div 40 + 1 AS int)").alias("page_no"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("fetched_at"),
    )


def review_pages(spark, sf: str) -> DataFrame:
    """One page per line item: a review with an id and one without, in layouts by order key."""
    lines = spread(base(spark, sf, "lineitem"), "l_orderkey")
    k = "l_orderkey"
    rid = f"concat('R', {k}, 'x', l_linenumber)"
    text = f"concat('Works for ', {k})"
    body = _html(
        _pick(k, [
            f"""concat('<div data-hook="review" id="customer_review-', {rid}, '">')""",
            f"""concat('<div class="a-section review" id="', {rid}, '">')""",
            f"""concat('<div id="customer_review-', {rid}, '">')""",
        ]),
        """concat('<span class="a-profile-name"> Ann ', l_suppkey, '</span>')""",
        _pick(k, [
            """'<i data-hook="review-star-rating"><span class="a-icon-alt">4.0 out of 5 stars</span></i>'""",
            """concat('<i class="review-rating"><span class="a-icon-alt">', cast(l_quantity % 5 + 1 AS int), '.9</span></i>')""",
            """'<i><span class="a-icon-alt">none</span></i>'""",
        ]),
        _pick(k, [
            f"""concat('<a data-hook="review-title"><span class="a-size-base">4.0 x</span><span>Good ', {k}, '</span></a>')""",
            f"""concat('<b data-hook="review-title">ok</b><b class="review-title">Fine ', {k}, '</b>')""",
        ], 3),
        """concat('<span data-hook="review-date">Reviewed in Canada on ', date_format(l_shipdate, 'MMMM d, yyyy'), '</span>')""",
        """CASE WHEN l_linestatus = 'F' THEN '<span data-hook="avp-badge">Verified</span>' ELSE '' END""",
        _pick(k, [
            f"""concat('<span data-hook="review-body"><span>', {text}, '</span></span>')""",
            f"""concat('<div data-hook="review-body">', {text}, '<style>x</style></div>')""",
            f"""concat('<span data-hook="review-body"></span><div class="review-text-content"><span>', {text}, '</span></div>')""",
        ]),
        f"""concat('<span data-hook="helpful-vote-statement">', {k} % 80, ' people found this helpful</span><a data-hook="format-strip">Size: ', l_linenumber, '</a></div>')""",
        _pick(k, [
            f"""concat('<div data-hook="review">plain ', {k}, '\n <b>text</b></div>')""",
            f"""concat('<div class="review">plain ', {k}, '\n <b>text</b></div>')""",
        ], 3),
    )
    return lines.select(
        F.expr("cast(round(l_extendedprice * 100) AS bigint)").alias("page_id"),
        F.expr(f"concat('https://www.amazon.com/product-reviews/', {ASIN.format('l_partkey')}, '/ref=x?ie=UTF8&pageNumber=', l_linenumber)").alias("url"),
        F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"),
        F.lit("review").alias("page_kind"),
        F.expr(ASIN.format("l_partkey")).alias("asin"),
        F.col("l_linenumber").cast("int").alias("page_no"),
        F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
    )
