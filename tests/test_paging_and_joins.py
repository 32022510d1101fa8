"""Pagination, dedup and joins against plain Python loops, with hot keys; and the plans they get."""

import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import dedup, joins, merged, paging, ranking

DDL = "asin string, page_no int, bad boolean, review_id string, pos int"


def walk(pages, cap):
    """The page-by-page loop the closed form stands for."""
    kept = []
    for asin in {p[0] for p in pages}:
        seen = set()
        for number in range(1, cap + 1):
            rows = sorted((r for r in pages if r[0] == asin and r[1] == number), key=lambda r: r[4])
            if not rows or any(r[2] for r in rows):
                break
            fresh = []
            for r in rows:
                if r[3] is not None and r[3] not in seen:
                    seen.add(r[3])
                    fresh.append((asin, number, r[3], r[4]))
            if number > 1 and not fresh:
                break
            kept += fresh
    return sorted(kept)


def random_pages(seed):
    rng, out = random.Random(seed), []
    for asin in range(25):
        for number in range(1, rng.randint(1, 8)):
            if rng.random() < 0.12:
                continue
            bad = rng.random() < 0.08
            count = rng.choice([0, 1, 2, 3])
            ids = [f"r{rng.randint(0, 9)}" for _ in range(count)] or [None]
            out += [(f"A{asin}", number, bad, rid, pos) for pos, rid in enumerate(ids)]
    return out


@pytest.mark.parametrize("hot", [{}, {"min_rows": 2}])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_review_cut_equals_the_page_loop(spark, seed, hot):
    pages = random_pages(seed)
    got = paging.cut_review_pages(spark.createDataFrame(pages, DDL), cap=6, **hot)
    assert sorted(tuple(r) for r in got.select("asin", "page_no", "review_id", "pos").collect()) == walk(pages, 6)


def test_review_cut_fixture(spark):
    pages = [("A", 1, False, "r1", 0), ("A", 1, False, "r2", 1), ("A", 2, False, "r2", 0), ("A", 2, False, "r3", 1),
             ("A", 3, False, "r1", 0), ("A", 3, False, "r3", 1), ("A", 4, False, "r4", 0)]
    got = paging.cut_review_pages(spark.createDataFrame(pages, DDL)).collect()
    assert sorted((r.review_id, r.page_no) for r in got) == [("r1", 1), ("r2", 1), ("r3", 2)]


def test_search_pages_end_where_there_is_no_next(spark):
    rows = [("k", 1, True), ("k", 2, False), ("k", 3, True), ("j", 1, True), ("j", 5, True)]
    got = paging.until_last_page(spark.createDataFrame(rows, "keyword string, page_no int, has_next boolean"))
    assert sorted((r.keyword, r.page_no) for r in got.collect()) == [("j", 1), ("j", 5), ("k", 1), ("k", 2)]


def skewed(spark, rows=3000):
    """A third of the rows under one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(rows).select(key.alias("asin"), F.col("id").alias("n"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, how):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("other", 4)], "asin string, v int")
    plain, salted = left.join(right, "asin", how), joins.salted_join(left, right, "asin", how, ["n"], min_rows=100)
    assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()


def test_hot_keys_are_few_and_cut_small(spark, monkeypatch):
    hot = joins.hot_keys(skewed(spark), ["asin"], min_rows=150)
    assert [(r.asin, r.pieces) for r in hot.collect()] == [("hot", 7)]
    monkeypatch.setattr(joins, "HOT_KEYS", 10)  # above a tenth of all rows a key is hot, whatever the least number
    assert [(r.asin, r.pieces) for r in joins.hot_keys(skewed(spark), ["asin"], min_rows=1).collect()] == [("hot", 4)]


def test_every_hot_key_is_cut(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id") % 3_000).alias("asin"), F.col("id").alias("n"))
    hot = joins.hot_keys(rows, ["asin"], min_rows=4)
    assert hot.count() == 3_000 and {r.pieces for r in hot.collect()} == {3}


def test_one_per_key_is_cut_before_the_shuffle(spark):
    plan = dedup.first_per(skewed(spark), ["asin"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_numbering_over_many_ranges(spark):
    got = ranking.numbered(skewed(spark).repartition(7), [F.asc("asin"), F.desc("n")]).collect()
    expected = sorted(((r.asin, r.n) for r in got), key=lambda t: (t[0], -t[1]))
    assert [(r.asin, r.n) for r in sorted(got, key=lambda r: r.position)] == expected
    assert sorted(r.position for r in got) == list(range(1, 3001))


def test_merged_view_has_no_cross_join_and_prunes_columns(spark, folder):
    from shelfscope.sources.tables import Store

    store = Store(spark, folder).create()
    for name, key in (("search_results", "search_keyword"), ("products", "brand"), ("reviews", "review_id")):
        store[name].upsert(spark.createDataFrame([("a", "x")], f"asin string, {key} string"))
    plan = merged.merged_view(*[store.read(n) for n in ("search_results", "products", "reviews")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "BroadcastNestedLoop" not in text
    assert "bullet_points" not in text and "content" not in text


def test_dedup_within_then_across_keywords_is_one_window(spark):
    rng = random.Random(3)
    rows = [(f"a{rng.randint(0, 20)}", f"k{w}", w, p, i) for w in range(3) for p in range(1, 4) for i in range(6)]
    items = spark.createDataFrame(rows, "asin string, search_keyword string, keyword_ord int, page_no int, pos int")
    twice = dedup.first_listing(dedup.first_listing_per_keyword(items))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, dedup.first_listing(items).collect()))
