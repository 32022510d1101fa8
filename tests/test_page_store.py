"""Pages laid out by asin: what a work list reads, and that it gets all it lists."""

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import membership
from shelfscope.plans import jobs
from shelfscope.sources.pages import read_pages, with_context, write_page_store

PAGES = 40_000


@pytest.fixture(scope="module")
def store(spark):
    from shelfscope.session import scratch_path

    path = scratch_path(spark, "pages")
    asin = F.format_string("B%09d", (F.col("id") / 4).cast("long"))
    pages = spark.range(PAGES).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://www.amazon.com/product-reviews/"), asin, F.lit("/?pageNumber="), F.col("id") % 4 + 1).alias("url"),
        F.lit("<p></p>").alias("html"),
    )
    write_page_store(with_context(pages), path)
    return path


def listed(spark, count):
    """``count`` asins, half of them with pages."""
    return spark.range(count).select(F.format_string("B%09d", F.when(F.col("id") % 2 == 0, F.col("id") / 2).otherwise(F.col("id") + 10**8).cast("long")).alias("asin"))


@pytest.mark.parametrize("count", [10, 10_000, 2_000_000])
def test_pages_parsed_are_about_those_listed(spark, store, count):
    parsed = spark.sparkContext.accumulator(0)

    def parse(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    def extract(pages):
        narrow = pages.select("page_id", "asin")
        return narrow.mapInArrow(parse, narrow.schema)

    found = jobs.for_asins(read_pages(spark, store), listed(spark, count), extract)
    there = min(count // 2, PAGES // 4) * 4
    assert found.count() == there and there <= parsed.value <= there + 0.15 * (PAGES - there)


def test_a_list_reads_only_its_folders_and_row_groups(spark, store):
    plan = jobs.pages_of(read_pages(spark, store), listed(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert "page_bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and "In(asin, [" in plan
    files = {r[0] for r in jobs.pages_of(read_pages(spark, store), listed(spark, 10)).select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(files) <= 5


def test_the_filter_stops_no_listed_key_and_few_others(spark):
    keys = spark.range(50_000).select(F.concat(F.lit("k"), F.col("id")).alias("asin"))
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id")).alias("asin"), "id")
    got = membership.likely_in(rows, keys, "asin", 50_000)
    assert got.where("id < 50000").count() == 50_000 and got.where("id >= 50000").count() < 15_000
    assert membership.words_for(10**9) == membership.MOST_WORDS and membership.words_for(0) == 1
    assert membership.likely_in(rows, keys.limit(0), "asin", 0).count() == 0
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
