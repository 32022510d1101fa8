"""Work is dealt out, and done once, however the input lies."""

from pyspark.sql import functions as F

from checks import refusals
from shelfscope.operators import quality
from shelfscope.plans import upkeep
from shelfscope.sources.tables import KeyedTable, Store
from shelfscope.streaming import review_state
from shelfscope.streaming.review_state import kept_reviews


def test_broken_items_are_read_by_all_slots(spark, folder, monkeypatch):
    spark.range(50).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    parts, rows_of = [], refusals.jobs.search_rows

    def search_rows(pages, settings):
        parts.append(pages.rdd.getNumPartitions())
        return rows_of(pages, settings)

    monkeypatch.setattr(refusals.jobs, "search_rows", search_rows)
    assert refusals.search_past_broken_items(spark, folder).count() == 150
    assert parts == [spark.sparkContext.defaultParallelism]


def test_captcha_patterns_are_for_pages_with_the_word(spark):
    pages = spark.createDataFrame([("<IMG src=/captcha/1.jpg>",), ("<form action='/errors/validateCaptcha'>",), ("<p>captcha</p>",), ("<p>x</p>",), (None,)], "html string")
    asked = pages.select(quality.is_captcha(F.col("html")).alias("hit"))
    assert [r.hit for r in asked.collect()] == [True, True, False, False, False]
    assert "Contains(html" in asked._jdf.queryExecution().analyzed().toString()


def test_changes_of_added_parts_are_those_of_all_rows(spark, folder):
    """Three added parts, with repeated keys and keys that are NULL, against the way for versions that differ otherwise."""
    table = KeyedTable(spark, folder, "reviews", buckets=4).create()
    rows = spark.range(60).selectExpr("concat('A', id % 7) AS asin", "if(id % 5 = 0, null, 'b') AS brand", "concat('R', id) AS review_id", "cast(id % 5 AS int) AS rating")
    for n in range(4):
        table.upsert(rows.where(f"substr(review_id, 2) % 4 <= {3 - n}").withColumn("rating", F.col("rating") + n))
    seen = lambda df: sorted((tuple(r) for r in df.select("asin", "brand", "review_id", "rating", "change").collect()), key=str)
    for since, upto in ((0, 2), (2, 3), (2, 5), (3, 5), (5, 5)):
        got = seen(table.changes(since, upto))
        whole = {sign: table.read(version).withColumn("change", F.lit(sign)) for sign, version in ((-1, since), (1, upto))}
        touched, keyless = spark.createDataFrame([], "asin string, brand string, review_id string"), []
        for part in table._manifest(upto)["parts"][len(table._manifest(since)["parts"]) :]:
            touched = touched.unionByName(table._part_rows(part).select("asin", "brand", "review_id"))
            keyless += [(r.asin, r.brand, r.review_id, r.rating, 1) for r in table._part_rows(part).where("brand IS NULL").collect()]
        same_key = lambda a: a.join(touched.distinct(), ["asin", "brand", "review_id"], "left_semi")
        expected = seen(same_key(whole[-1]).unionByName(same_key(whole[1]))) + keyless
        assert got == sorted(expected, key=str)
        assert {r[0] for r in table.changed_keys(since, upto).collect()} == {r[0] for r in got}


def test_added_parts_are_not_looked_up_in_the_table(spark, folder):
    table = KeyedTable(spark, folder, "products").create()
    table.upsert(spark.sql("SELECT 'A' AS asin, 'b' AS brand"))
    assert "Join" not in table.changes(0)._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_one_table_read_its_changes_once(spark, folder, monkeypatch):
    store, asked, changes = Store(spark, f"{folder}/store", buckets=4).create(), [], KeyedTable.changes

    def counted(self, *versions):
        asked.append(self.name)
        return changes(self, *versions)

    monkeypatch.setattr(KeyedTable, "changes", counted)
    store["reviews"].upsert(spark.sql("SELECT concat('A', id % 3) AS asin, concat('b', id % 2) AS brand, concat('R', id) AS review_id, 5 AS rating FROM range(6)"))
    kept = upkeep.KeptFigures(store, f"{folder}/kept").update()
    assert asked.count("reviews") == 1
    assert sorted((r.asin, r.total) for r in kept.review_stats_by_asin().collect()) == [("A0", 2), ("A1", 2), ("A2", 2)]
    assert sorted((r.brand, r.reviews) for r in kept.brand_progress().collect()) == [("b0", 3), ("b1", 3)]


def test_a_stream_keeps_odd_texts_and_passes_one_column(spark, folder):
    """What a product costs in the keyed step goes with the columns that cross to Python."""
    said = ['He said "fine"', "a \\ b\tc", "naïve \U0001f600   text", None]
    rows = [("A1", 1, n, f"R{n}", t) for n, t in enumerate(said)] + [("A2", 2, 0, "R9", "waits"), (None, 1, 0, "R8", "no product")]
    types = "asin string, page_no int, pos int, review_id string, content string"
    more = {"page_id": F.lit(2**60).cast("long"), "fetched_at": F.lit(None).cast("timestamp"), "bad": F.lit(None).cast("boolean"), "rating": F.lit(4), "helpful_votes": F.lit(None).cast("int")}
    more |= {"verified_purchase": F.lit(1)} | {c: F.lit(None).cast("string") for c in ("title", "date", "author", "variant")}
    spark.createDataFrame(rows, types).withColumns(more).write.parquet(f"{folder}/rows")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/rows").schema).parquet(f"{folder}/rows")
    kept = kept_reviews(stream, 10)
    run = kept.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/kept")
    run.awaitTermination()
    got = spark.read.parquet(f"{folder}/kept").select("asin", "review_id", "content", "rating", "helpful_votes").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((("A1", f"R{n}", t, 4, None) for n, t in enumerate(said)), key=str)
    assert len(review_state.STATE.split(",")) == 1 and len(review_state.KEPT.split(",")) == 2
