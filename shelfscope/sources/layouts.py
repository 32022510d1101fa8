"""Which elements of a search, product or review page hold which field.

Each reader returns plain candidates; each ``*_FOUND`` string is their Spark type.
"""

from __future__ import annotations

# Every selector below names markup of the stored pages, in the order in which it counts.

# ---- search ---------------------------------------------------------------------------------
SEARCH_ITEM = ['div[data-component-type="s-search-result"]', "div.s-result-item[data-asin]"]
SEARCH_FIRST_TEXT = {
    "title": [
        "h2 a.a-link-normal span.a-text-normal",
        "h2 a span.a-text-normal",
        "h2.a-size-mini a span",
        "h2 a.a-link-normal",
        'span[data-component-type="s-product-title"] span',
    ],
    "price": ["span.a-price span.a-offscreen", "span.a-price-whole", "span.a-color-price"],
    "original_price": ["span.a-price.a-text-price span.a-offscreen", 'span[data-a-strike="true"] span.a-offscreen'],
    "rating": ["i.a-icon-star-small span.a-icon-alt", "i.a-icon-star span.a-icon-alt", "span.a-icon-alt"],
    "brand": [
        'h5.s-line-clamp-1 a[href*="/s?k="]',
        "h5.s-line-clamp-1 a",
        'a.a-size-base-plus.a-link-normal[href*="/s?k="]',
        "span.a-size-base-plus.a-color-base",
        "div.a-row.a-size-base.a-color-base a",
        "a.a-size-base.a-link-normal",
    ],
    "brand_v1": [
        "h5.s-line-clamp-1 a",
        "span.a-size-base-plus.a-color-base",
        "div.a-row.a-size-base.a-color-base",
        "a.a-size-base.a-link-normal",
    ],
}
SEARCH_COUNTS = [
    "span.a-size-base.s-underline-text",
    'a[href*="#customerReviews"] span.a-size-base',
    'span[aria-label*="ratings"]',
]
SEARCH_AD = (
    'span.s-label-popover-default, span[data-component-type="s-ad-badge"], div.s-ad-badge, '
    "span.puis-label-popover-default"
)
SEARCH_BADGES = "span.a-badge-text, span.a-badge-label"
SEARCH_NEXT = "a.s-pagination-next:not(.s-pagination-disabled)"

_SEARCH_ITEM_TYPE = (
    "struct<asin:string,title:array<string>,price:array<string>,original_price:array<string>,rating:array<string>,"
    "brand:array<string>,brand_v1:array<string>,heading:string,heading_spans:array<string>,link_label:string,"
    "star_label:string,counts:array<string>,count_label:string,ad_badge:boolean,ad_spans:array<string>,"
    "badges:array<string>,image:string>"
)
# Items that cannot be read are NULL in their places; ``faults`` tells which and why.
_FAULTS = "faults array<struct<pos:int,kind:string>>"
SEARCH_FOUND = f"has_next boolean, items array<{_SEARCH_ITEM_TYPE}>, {_FAULTS}"


class BrokenText(ValueError):
    """Something that no text can be made of."""


def _items(page, containers, read) -> dict:
    """``read`` applied to each container, whatever is wrong with the others. What is broken outside of them is the whole page's fault."""
    items, faults = [], []
    if any(not any(c.order <= at <= c.last for c in containers) for at in page.broken):
        raise BrokenText
    for pos, item in enumerate(containers):
        try:
            if page.broken and page.is_broken(item):
                raise BrokenText
            items.append(read(page, item))
        except Exception as e:  # one malformed item must not take the others with it
            items.append(None)
            faults.append({"pos": pos, "kind": type(e).__name__})
    return {"items": items, "faults": faults}


def _text(page, selector, scope=None):
    e = page.one(selector, scope)
    return None if e is None else page.text(e)


def _attr(page, selector, name, scope=None):
    e = page.one(selector, scope)
    return None if e is None else e.get(name)


def _containers(page, selectors):
    for selector in selectors:
        found = list(page.select(selector))
        if found:
            return found
    return []


def _search_item(page, item) -> dict:
    row = {name: page.first_texts(selectors, item) for name, selectors in SEARCH_FIRST_TEXT.items()}
    heading = page.one("h2", item)
    spans = [] if heading is None else [page.text(s) for s in page.select("span", heading)]
    said = (page.text(s) for s in page.select("span", item))
    row.update(
        asin=item.get("data-asin"),
        heading=None if heading is None else page.text(heading),
        heading_spans=spans,
        link_label=_attr(page, 'a.a-link-normal[href*="/dp/"]', "aria-label", item),
        star_label=_attr(page, 'i[class*="a-icon-star"]', "aria-label", item),
        counts=[page.text(e) for s in SEARCH_COUNTS for e in page.select(s, item)],
        count_label=_attr(page, 'a[href*="#customerReviews"]', "aria-label", item),
        ad_badge=page.one(SEARCH_AD, item) is not None,
        ad_spans=[t for t in said if "sponsored" in t.lower()],
        badges=[page.text(e) for e in page.select(SEARCH_BADGES, item)],
        image=_attr(page, "img.s-image", "src", item),
    )
    return row


def read_search(page) -> dict:
    found = _items(page, _containers(page, SEARCH_ITEM), _search_item)
    return {"has_next": page.one(SEARCH_NEXT) is not None, **found}


# ---- product --------------------------------------------------------------------------------
PRODUCT_FIRST_TEXT = {
    "title": ["#productTitle", "h1#title span", "h1.a-size-large"],
    "brand": ["#bylineInfo", "a#bylineInfo", ".po-brand .po-break-word"],
    "price": [
        "span.a-price.aok-align-center span.a-offscreen",
        "#corePrice_feature_div span.a-offscreen",
        "#priceblock_ourprice",
        "#priceblock_dealprice",
        "span.a-price span.a-offscreen",
    ],
    "original_price": [
        "span.a-price.a-text-price span.a-offscreen",
        ".a-text-strike",
        'span[data-a-strike="true"] span.a-offscreen',
    ],
    "rating_count": ["#acrCustomerReviewText"],
    "bought": [
        "#social-proofing-faceout-title-tk_bought .a-text-bold",
        "#social-proofing-faceout-title-tk_bought span",
        "#socialProofingAsinFaceout_feature_div .a-text-bold",
        "#socialProofingAsinFaceout_feature_div span.a-text-bold",
        'span[data-csa-c-content-id*="social-proofing"]',
        "#social-proofing-faceout-title-tk_bought",
        ".social-proofing-faceout-title-container",
    ],
    "description": ["#productDescription p", "#productDescription", 'div[data-feature-name="productDescription"]'],
    "seller": [
        "#sellerProfileTriggerId",
        "#merchant-info a",
        "#tabular-buybox-truncate-1 span a",
        "#tabular-buybox span.tabular-buybox-text a",
        'div[data-feature-name="merchantName"] a',
    ],
    "availability": ["#availability span"],
}
PRODUCT_RATING = ["#acrPopover", "#averageCustomerReviews span.a-icon-alt"]
PRODUCT_STAR_ROWS = "#histogramTable tr, #cm_cr_dp_d_rating_histogram tr"
PRODUCT_STAR_CELL = "td.a-text-right a, td:first-child"
PRODUCT_SHARE_CELL = "td.a-text-right ~ td a, td:nth-child(3) a"
PRODUCT_STAR_LINKS = 'table#histogramTable tr a, #reviewsMedley a[href*="filterByStar"]'
PRODUCT_STAR_BARS = '.a-histogram-row, div[class*="histogram"] div[class*="row"]'
PRODUCT_SALES_RANK_ROWS = [
    "#productDetails_detailBullets_sections1 tr",
    "#detailBullets_feature_div li",
    "table.prodDetTable tr",
    "#productDetails_db_sections tr",
]
PRODUCT_SUB_RANK_LINKS = '#SalesRank a, #productDetails_detailBullets_sections1 a[href*="/gp/bestsellers/"]'
PRODUCT_BULLETS = [
    "#feature-bullets li:not(.aok-hidden) span.a-list-item",
    "#feature-bullets ul li span",
    'div[id="feature-bullets"] li span',
]
PRODUCT_IMAGES = ["#altImages img", "#imageBlock img", "li.image.item img"]
PRODUCT_MAIN_IMAGE = "#landingImage, #imgBlkFront"
PRODUCT_VARIANTS = [
    "#twister li[data-defaultasin]",
    "#variation_color_name li",
    "#variation_size_name li",
    ".swatchesSquare li",
]
PRODUCT_MERCHANT = "#merchant-info, #tabular-buybox"
PRODUCT_DELIVERY = ["#SSOFpopoverLink", "#deliveryMessageMirId"]
PRODUCT_PRIME = "#primeExclusiveBadge, i.a-icon-prime"
PRODUCT_APLUS = "#aplus, #aplus_feature_div, .aplus-v2, #aplusBrandStory_feature_div"
PRODUCT_DATE_ROWS = ["#productDetails_detailBullets_sections1 tr", "#detailBullets_feature_div li"]

PRODUCT_FOUND = ", ".join(f"{name} array<string>" for name in PRODUCT_FIRST_TEXT) + (
    ", rating array<string>, star_rows array<struct<star:string,share:string>>, star_labels array<string>, "
    "star_bars array<string>, bought_spans array<string>, sales_rank_rows array<string>, "
    "sub_ranks array<struct<context:string,category:string,url:string>>, bullets array<array<string>>, "
    "images array<string>, main_image string, "
    "variants array<struct<asin:string,value:string,classes:array<string>>>, merchant string, "
    "delivery array<string>, prime boolean, aplus boolean, date_rows array<string>"
)


def _rows_about(page, selectors, phrase):
    texts = (page.raw_text(e) for s in selectors for e in page.select(s))
    return [t for t in texts if phrase in t]


def _nearest(element, tags):
    up = element.parent
    while up is not None and up.tag not in tags:
        up = up.parent
    return up


def read_product(page) -> dict:
    if page.broken:
        raise BrokenText
    row = {name: page.first_texts(selectors) for name, selectors in PRODUCT_FIRST_TEXT.items()}
    rated = [page.one(s) for s in PRODUCT_RATING]
    bars = (page.one("a, span", bar) for bar in page.select(PRODUCT_STAR_BARS))
    spans = (page.text(e) for e in page.tagged("span"))
    ranked = [(link, _nearest(link, ("li", "td", "span"))) for link in page.select(PRODUCT_SUB_RANK_LINKS)]
    merchant = page.one(PRODUCT_MERCHANT)
    delivery = [page.one(s) for s in PRODUCT_DELIVERY]
    row.update(
        rating=[None if e is None else e.get("title") or page.text(e) for e in rated],
        star_rows=[
            {"star": _text(page, PRODUCT_STAR_CELL, tr), "share": _text(page, PRODUCT_SHARE_CELL, tr)}
            for tr in page.select(PRODUCT_STAR_ROWS)
        ],
        star_labels=[a.get("aria-label") or a.get("title") for a in page.select(PRODUCT_STAR_LINKS)],
        star_bars=[page.text(e) for e in bars if e is not None],
        bought_spans=[t for t in spans if "bought in past month" in t.lower()][:1],
        sales_rank_rows=_rows_about(page, PRODUCT_SALES_RANK_ROWS, "Best Sellers Rank"),
        sub_ranks=[
            {"context": page.raw_text(near), "category": page.text(link), "url": link.get("href")}
            for link, near in ranked
            if near is not None
        ],
        bullets=[[page.text(e) for e in page.select(s)] for s in PRODUCT_BULLETS],
        images=[e.get("src") or e.get("data-old-hires") for s in PRODUCT_IMAGES for e in page.select(s)],
        main_image=_attr(page, PRODUCT_MAIN_IMAGE, "data-a-dynamic-image"),
        variants=[
            {
                "asin": e.get("data-defaultasin") or e.get("data-asin"),
                "value": e.get("title") or page.text(e),
                "classes": e.classes,
            }
            for s in PRODUCT_VARIANTS
            for e in page.select(s)
        ],
        merchant=None if merchant is None else page.raw_text(merchant),
        delivery=[None if e is None else page.raw_text(e) for e in delivery],
        prime=page.one(PRODUCT_PRIME) is not None,
        aplus=page.one(PRODUCT_APLUS) is not None,
        date_rows=_rows_about(page, PRODUCT_DATE_ROWS, "Date First Available"),
    )
    return row


# ---- reviews --------------------------------------------------------------------------------
REVIEW_ITEM = ['div[data-hook="review"]', "div.review", 'div[id^="customer_review-"]']
REVIEW_FIRST_TEXT = {
    "title": [
        'a[data-hook="review-title"] span:not(.a-size-base)',
        '[data-hook="review-title"]',
        ".review-title",
    ],
    "content": ['span[data-hook="review-body"] span', '[data-hook="review-body"]', ".review-text-content span"],
    "rating": [
        'i[data-hook="review-star-rating"] span.a-icon-alt',
        "i.review-rating span.a-icon-alt",
        "span.a-icon-alt",
    ],
    "date": ['span[data-hook="review-date"]'],
    "votes": ['span[data-hook="helpful-vote-statement"]'],
    "author": ["span.a-profile-name"],
    "variant": ['a[data-hook="format-strip"]'],
}
REVIEW_VERIFIED = 'span[data-hook="avp-badge"]'
REVIEW_AUDIT = [
    'div[data-hook="review"]',
    "div.review",
    'div[id^="customer_review-"]',
    'span[data-hook="review-body"]',
    "div.a-section.review",
]

_REVIEW_ITEM_TYPE = (
    "struct<id:string,opening:string,"
    + ",".join(f"{name}:array<string>" for name in REVIEW_FIRST_TEXT)
    + ",verified:boolean>"
)
REVIEW_FOUND = f"items array<{_REVIEW_ITEM_TYPE}>, {_FAULTS}"
AUDIT_FOUND = "matches array<bigint>"


def _review_item(page, item) -> dict:
    row = {name: page.first_texts(selectors, item) for name, selectors in REVIEW_FIRST_TEXT.items()}
    row.update(
        id=item.get("id"),
        opening=None if item.get("id") else page.raw_text(item)[:100],
        verified=page.one(REVIEW_VERIFIED, item) is not None,
    )
    return row


def read_reviews(page) -> dict:
    return _items(page, _containers(page, REVIEW_ITEM), _review_item)


def read_audit(page) -> dict:
    return {"matches": [sum(1 for _ in page.select(s)) for s in REVIEW_AUDIT]}


LAYOUTS = {
    "search": (read_search, SEARCH_FOUND),
    "product": (read_product, PRODUCT_FOUND),
    "review": (read_reviews, REVIEW_FOUND),
    "audit": (read_audit, AUDIT_FOUND),
}
