"""Jobs over stored pages; a stream ends where the batch does."""

import pytest
from pyspark.sql import functions as F

from shelfscope.plans import jobs
from shelfscope.sources import records
from shelfscope.sources.pages import with_context, write_pages
from shelfscope.sources.tables import Store
from shelfscope.streaming import incremental
from tests.test_extraction import PRODUCT, REVIEWS, SEARCH

RUN_ADDRESSES = [
    ("https://www.amazon.com/s?k=chef+knife&page=1", SEARCH),
    ("https://www.amazon.com/dp/B0TEST0001", PRODUCT),
    ("https://www.amazon.com/dp/B0OTHER001", PRODUCT),
    ("https://www.amazon.com/product-reviews/B0TEST0001/ref=x?pageNumber=1", REVIEWS),
    ("https://www.amazon.com/product-reviews/B0TEST0001/ref=x?pageNumber=2", REVIEWS),
    ("https://www.amazon.com/product-reviews/B0TEST0001/ref=x?pageNumber=3", REVIEWS.replace("R1", "R3")),
]


@pytest.fixture
def pages(spark):
    rows = [(n, url, html) for n, (url, html) in enumerate(RUN_ADDRESSES)]
    return with_context(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_whole_run(spark, folder, pages):
    store = Store(spark, f"{folder}/store").create()
    dashboard = jobs.run_all(pages, store, f"{folder}/files", jobs.Settings())
    counts = {r["name"]: r["value"] for r in dashboard.where("section = 'tables'").collect()}
    assert counts == {"search_results": 2.0, "products": 1.0, "reviews": 2.0, "scrape_tasks": 0.0}
    assert [r.asin for r in store.read("products").collect()] == ["B0TEST0001"]  # the other asin is not listed
    merged = spark.read.option("header", True).csv(f"{folder}/files/merged_data")
    assert merged.columns[0] == "asin" and merged.columns[1:] == sorted(merged.columns[1:]) and merged.count() == 2
    assert spark.read.json(f"{folder}/files/reviews_new.json").count() == 2


def test_a_second_run_has_nothing_left_to_do(spark, folder, pages):
    store = Store(spark, f"{folder}/store").create()
    jobs.run_all(pages, store, f"{folder}/files", jobs.Settings(min_reviews=1))
    before = store.read("products").select("updated_at").first()
    assert jobs.run_products(pages, store, f"{folder}/files", jobs.Settings()).count() == 0
    assert jobs.run_reviews(pages, store, f"{folder}/files", jobs.Settings(min_reviews=1)).count() == 0
    assert store.read("products").select("updated_at").first() == before


def test_jobs_tell_what_came_of_them(spark, folder, pages):
    store = Store(spark, f"{folder}/store").create()
    asins = spark.createDataFrame([("B0TEST0001",), ("B0ABSENT01",)], "asin string")
    jobs.run_products(pages, store, f"{folder}/files", jobs.Settings(), asins=asins)
    got = spark.read.parquet(f"{folder}/files/product_outcomes").collect()
    assert {(r.asin, r.succeeded) for r in got} == {("B0TEST0001", True), ("B0ABSENT01", False)}
    jobs.run_search(pages, store, f"{folder}/files", jobs.Settings(filter_by_brand=True, target_brands=["nobody"]))
    assert [tuple(r) for r in spark.read.json(f"{folder}/files/search_outcome").select("kept", "rejected").collect()] == [(0, 2)]


def test_work_lists_of_any_length_give_their_pages(spark, pages, monkeypatch):
    asins = spark.createDataFrame([("B0OTHER001",), (None,)], "asin string")
    short = jobs.for_asins(pages, asins, lambda p: jobs.product_details(p, jobs.Settings()))
    monkeypatch.setattr(jobs, "LITERAL_ASINS", 0)
    long = jobs.for_asins(pages, asins, lambda p: jobs.product_details(p, jobs.Settings()))
    assert [r.asin for r in short.collect()] == [r.asin for r in long.collect()] == ["B0OTHER001"]


def test_refused_review_page_stops_its_product(spark, pages):
    blocked = "<title>Sorry! Something went wrong</title>"
    html = F.when(F.col("url").contains("pageNumber=1"), F.lit(blocked)).otherwise(F.col("html"))
    read = jobs.review_page_candidates(pages.withColumn("html", html), 10)
    assert jobs.reviews_of_candidates(read, 10).count() == 0


def test_streams_end_where_batches_do(spark, folder, pages):
    store, batch = Store(spark, f"{folder}/stream").create(), Store(spark, f"{folder}/batch").create()
    settings = jobs.Settings()
    shop = pages.where("page_kind <> 'search'")
    for kind in ("product", "review"):
        for part in (0, 1):
            write_pages(shop.where((F.col("page_kind") == kind) & (F.col("page_id") % 2 == part)), f"{folder}/pages")
            stream = incremental.page_stream(spark, f"{folder}/pages")
            mark = f"{folder}/checkpoint-{kind}"
            if kind == "product":
                incremental.stream_products(stream, store, settings, mark).awaitTermination()
            else:
                incremental.stream_reviews(stream, store, settings, mark).awaitTermination()
    asins = shop.select("asin").distinct()
    jobs.run_products(pages, batch, f"{folder}/files", settings, asins=asins)
    jobs.run_reviews(pages, batch, f"{folder}/files", settings, asins=asins)
    for name in ("products", "reviews"):
        left, right = (s.read(name).drop("created_at", "updated_at") for s in (store, batch))
        assert left.count() == right.count() > 0 and left.exceptAll(right).isEmpty()


def test_csv_needs_an_asin_column(spark, folder):
    spark.createDataFrame([(1,)], "x int").write.option("header", True).csv(folder)
    with pytest.raises(ValueError):
        records.csv_seed(spark, folder)


def test_nothing_is_written_for_empty_data(spark, folder):
    none = spark.createDataFrame([], "asin string")
    assert not records.save_json(none, f"{folder}/a.json") and not records.export_csv(none, folder, "a")
    assert records.export_datasets({"a": none}, folder) == []
    assert records.load_json(spark, f"{folder}/a.json", "asin string").count() == 0


def test_pretty_printed_arrays_load(spark, folder):
    from shelfscope.sources import files

    files.create_text(spark, f"{folder}/a.json", '[\n {"asin": "B1", "n": null},\n {"asin": "B2", "n": 2}\n]')
    got = records.load_json(spark, f"{folder}/a.json", "asin string, n int", multi_line=True)
    assert sorted((r.asin, r.n or 0) for r in got.collect()) == [("B1", 0), ("B2", 2)]


def test_a_job_reads_only_its_kind_of_page(spark, folder, pages):
    from shelfscope.sources.pages import read_pages

    write_pages(pages, f"{folder}/pages")
    plan = jobs.product_details(read_pages(spark, f"{folder}/pages"), jobs.Settings())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(page_kind" in text and plan.count() == 2


def test_an_empty_upsert_adds_no_part(spark, folder):
    store = Store(spark, folder).create()
    store["products"].upsert(spark.createDataFrame([], "asin string, brand string"))
    assert store["products"]._latest()[1] == []


def test_whole_runs_and_streams_leave_no_scratch(spark, folder, pages):
    from shelfscope import session

    session.release_staged(spark)
    store, settings = Store(spark, f"{folder}/store").create(), jobs.Settings()
    jobs.run_all(pages, store, f"{folder}/files", settings)
    assert session._staged == []
    for part in (0, 1, 2):
        write_pages(pages.where((F.col("page_kind") == "review") & (F.col("page_no") == part + 1)), f"{folder}/pages")
        incremental.stream_reviews(incremental.page_stream(spark, f"{folder}/pages"), store, settings, f"{folder}/mark").awaitTermination()
    assert session._staged == []


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from shelfscope import session

    def conf(_key):
        from pyspark.errors import PySparkException

        raise PySparkException("not set")

    on_cluster = SimpleNamespace(conf=SimpleNamespace(get=conf), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        session.scratch_root(on_cluster)
    assert session.is_single_machine("local[8]") and not session.is_single_machine("local-cluster[3,2,1024]")


def test_an_apology_in_a_review_is_no_refusal(spark, pages):
    html = F.when(F.col("url").contains("pageNumber=2"), F.concat(F.col("html"), F.lit("<p>we're sorry</p>"))).otherwise(F.col("html"))
    read = jobs.review_page_candidates(pages.withColumn("html", html), 10)
    assert [r.bad for r in read.where("page_no = 2").collect()] == [False]


def test_a_page_that_cannot_be_read_is_counted_as_unreadable(spark):
    from shelfscope.operators import extract_review

    rows = spark.createDataFrame([(1, "B1", 1, "<p>&#" + "9" * 5000 + ";</p>")], "page_id long, asin string, page_no int, html string")
    assert [r.unreadable for r in extract_review.review_candidates(rows).collect()] == [True]


def test_staged_results_can_be_released(spark, folder):
    from shelfscope import session
    from shelfscope.sources import files

    session.stage(spark.range(3))
    path = session._staged[-1]
    assert files.exists(spark, path)
    session.release_staged(spark)
    assert not files.exists(spark, path) and not session._staged
