"""Plain markup is read without ``HTMLParser`` and gives the tree that the parser gives."""

import random

import pytest

from shelfscope.sources import dom, layouts

BITS = [
    '<div class="review" id="customer_review-R1">', "<div>", "</div>", '<span class="a-size-base s-underline-text">', "</span>", "<p>", "<br>", "<br/>", "<div/>",
    '<img src="a>b">', "<img class='s-image' src='x&amp;y'>", '<a href="/s?k=b" class="a-link-normal">', "</a>", "<!-- c -->", "<!-->", "<!-- a -- b -->", "<!DOCTYPE html>",
    '<script>var a="<span>x</span>";</script>', "<script>", "<style>a</style>", "<STYLE>b</Style >", "<title>a &amp; b</title>", "<title>a <b>c</b></title>",
    "<textarea> </textarea>", "<pre> \n</pre>", "text", " ", " \n ", "&amp;", "&", "&lt", "&#39;", "&#" + "9" * 4400 + ";", "<", "</>", "<td class=a-text-right id=x>", "<td a=b/>",
    "<b title=\"5 & 6\" Data-X='q\"'>", '<b a="1"b="2">', "<b a=1 a=2 disabled>", "<h2>", '<div data-component-type="s-search-result" data-asin="B000000001">', "<xmp>x</xmp>", "é ",
]
SELECTORS = [*layouts.REVIEW_AUDIT, layouts.SEARCH_NEXT, layouts.PRODUCT_SHARE_CELL, "b ~ b", "b:nth-child(2)", "span:not(:first-child)", "div:not(.review) span", "[id]", "div b, a"]


class Slow(dom.Page):
    """All markup through the parser."""

    def _plain(self, html):
        return 0


def seen(page):
    tree = [(e.tag, e.attrs, e.order, e.last, e.nth, e.t0, e.t1, e.parent.order) for e in page.elements]
    return tree, page.texts, page.broken


@pytest.mark.parametrize("seed", range(4))
def test_both_ways_give_one_tree(seed):
    rng = random.Random(seed)
    for _ in range(250):
        html = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 25)))
        plain, slow = dom.Page(html), Slow(html)
        assert seen(plain) == seen(slow), html
        for selector in SELECTORS:
            scope = rng.choice([None, *range(len(slow.elements))])
            found = [[e.order for e in p.select(selector, None if scope is None else p.elements[scope])] for p in (plain, slow)]
            every = [e.order for e in slow.elements if any(dom._chain_fits(e, c.steps, len(c.steps) - 1) for c in dom.compiled(selector))]
            inside = every if scope is None else [n for n in every if scope < n <= slow.elements[scope].last]
            assert found == [inside, inside], (html, selector)


def test_plain_pages_never_reach_the_parser(monkeypatch):
    def feed(self, data):
        raise AssertionError(f"not plain: {data[:40]}")

    monkeypatch.setattr(dom.Page, "feed", feed)
    html = (
        "<!DOCTYPE html><html><head><title>A &amp; b</title><style>p > b {}</style></head><body><!-- list --><div class='s-main-slot'>"
        '<div data-component-type="s-search-result" data-asin="B000000001"><img src="a>b"/><h2><span>A title of it</span></h2><p>&#39;open</div><td id=x disabled></body></html>'
    )
    page = dom.Page(html)
    assert page.text(page.one("title")) == "A & b" and page.text(page.one("p")) == "'open"
    assert layouts.read_search(page)["items"][0]["heading"] == "A title of it"
