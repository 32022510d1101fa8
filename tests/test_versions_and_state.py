"""Changes between table versions, reads without an exchange, and the state of review streams against the page loop."""

import random

import pytest

from shelfscope.sources.tables import KeyedTable
from shelfscope.streaming.review_state import NAMES, Pages
from tests.test_paging_and_joins import random_pages, walk

DDL = "asin string, brand string, title string"


def table(spark, folder, *batches):
    out = KeyedTable(spark, folder, "products", buckets=4).create()
    for rows in batches:
        out.upsert(spark.createDataFrame(rows, DDL))
    return out


def told(df):
    return sorted((r["change"], r["asin"], r["brand"] or "", r["title"]) for r in df.collect())


def test_changes_tell_old_rows_out_and_new_rows_in(spark, folder):
    t = table(spark, folder, [("a", "x", "1"), ("b", "x", "1"), ("c", None, "1")], [("a", "x", "2"), ("d", "x", "1"), ("c", None, "2")])
    first, last = t.version() - 1, t.version()
    assert told(t.changes(first, last)) == [(-1, "a", "x", "1"), (1, "a", "x", "2"), (1, "c", "", "2"), (1, "d", "x", "1")]
    assert t.changes(last).count() == 0 and t.changes(0).where("change = 1").count() == t.read().count() == 5
    net = t.fold().changes(last).groupBy("asin", "brand", "title").sum("change").where("`sum(change)` <> 0")
    assert net.count() == 0  # folding changes nothing
    t.reset(confirm=True)
    assert {r[0] for r in told(t.changes(last))} == {-1}


def test_the_first_part_is_read_where_it_lies(spark, folder):
    t = table(spark, folder, [(f"a{i}", "x", "1") for i in range(50)], [("a1", "x", "2")], [("a2", "x", "3")])
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    base = plan[: plan.index("BroadcastExchange")]
    assert "LeftAnti" in base and "Exchange hashpartitioning" not in base and t.read().count() == 50
    some = t.of_keys(spark.createDataFrame([("a1",)], "asin string"))
    assert [r.title for r in some.collect()] == ["2"] and "_bucket" in some._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(40))
def test_state_ends_where_the_page_loop_does(seed):
    """Pages in any order and in batches of any size, with older copies between them."""
    rng, pages = random.Random(seed), random_pages(seed)
    arrivals = sorted({(p[0], p[1]) for p in pages}, key=lambda _: rng.random())
    states, got = {}, {}
    while arrivals:
        size = rng.randint(1, 12)
        taken, arrivals = arrivals[:size], arrivals[size:]
        touched = {a for a, _ in taken}
        for asin, number in taken:
            for a, n, bad, rid, pos in pages:
                if (a, n) == (asin, number):
                    row = {"page_no": n, "bad": bad, "fetched": 2, "page_id": n, "pos": pos, "review_id": rid, **dict.fromkeys(NAMES)}
                    mine = states.setdefault(asin, Pages([]))
                    for copy in ({"fetched": 1, "review_id": "old", "bad": bad}, {}, {"fetched": 3, "bad": True} if not bad else {}):
                        mine.take(row | copy)
        for asin in touched:
            for r in states[asin].advance(6):
                got[asin, r["review_id"]] = True
    assert sorted(got) == sorted({(a, rid) for a, _, rid, _ in walk(pages, 6)})
