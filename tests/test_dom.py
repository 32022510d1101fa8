"""Tree and selector rules of the DOM helper."""

import pytest

from shelfscope.sources.dom import Page


def texts(html, selector):
    page = Page(html)
    return [page.text(e) for e in page.select(selector)]


@pytest.mark.parametrize(
    "selector, found",
    [
        ("b", ["1", "2", "3"]),
        ("#x b", ["1", "2"]),
        ("div.k b", ["1", "2"]),
        ("div.k.l b", ["1", "2"]),
        ("div.m b", []),
        ('[data-a="v w"]', ["3"]),
        ('[data-a*="w"]', ["3"]),
        ('b[data-a^="v"]', ["3"]),
        ('b[data-a^="w"]', []),
        ('[class*="k l"] b', ["1", "2"]),
        ("b:not(.no)", ["1", "3"]),
        ("b:first-child", ["1", "3"]),
        ("b:nth-child(2)", ["2"]),
        ("b ~ b", ["2"]),
        ("b.no, p b, #none b", ["2", "3"]),
        ("p b, div b", ["1", "2", "3"]),
    ],
)
def test_selectors(selector, found):
    html = '<div id=x class="k l"><b>1</b><b class="no">2</b></div><p><b data-a="v w">3</b></p>'
    assert texts(html, selector) == found


def test_matches_stay_inside_the_scope_but_ancestors_may_lie_outside():
    page = Page("<section><div><i>1</i></div><div><i>2</i></div></section><i>3</i>")
    second = list(page.select("div"))[1]
    assert [page.text(e) for e in page.select("section i", second)] == ["2"]
    assert page.one("div", second) is None


def test_void_elements_close_at_once_and_stray_end_tags_are_ignored():
    assert texts("<div>a<br>b<img src=x>c</i></div><p>d", "div") == ["abc"]
    assert texts("<div>a</br>b</div>", "div") == ["ab"]


def test_unclosed_elements_end_with_their_parent():
    assert texts("<div><p>a<p>b</div><u>c</u>", "p") == ["ab", "b"]
    assert texts("<div><span>a", "span") == ["a"]
    assert texts("<div/><i>x</i>", "div i") == []


def test_text_is_trimmed_by_piece_and_joined_with_nothing():
    assert texts("<div> a <b> b\n</b>\t<!-- no --> c </div>", "div") == ["abc"]


def test_raw_text_keeps_breaks_and_folds_blank_pieces():
    page = Page("<div>a\n <b> </b>\n  \n<i>x</i></div>")
    assert page.raw_text(page.one("div")) == "a\n  \nx"


def test_script_style_and_template_text_is_not_page_text():
    html = "<div>a<script>b</script><style>c</style><template><u>d</u></template></div>"
    assert texts(html, "div") == ["a"] and texts(html, "script") == ["b"] and texts(html, "u") == [""]


def test_entities_and_duplicate_attributes():
    page = Page('<a title="x &amp; y" id="1" id="2">&lt;&#39;&eacute;</a>')
    link = page.one("a")
    assert (page.text(link), link.get("title"), link.get("id")) == ("<'é", "x & y", "2")
