"""Keyed tables, tasks, record files, exports and reports: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.relational import _BRANDS, _MERGED, _REVIEW_FIGURES, SRP
from checks.scalars import nested_products
from checks.views import base, oracle, view, views
from shelfscope import schemas
from shelfscope.operators import tasks
from shelfscope.operators.merged import merged_view
from shelfscope.operators.stats import table_counts
from shelfscope.session import scratch_path
from shelfscope.sources import records
from shelfscope.sources.tables import KeyedTable, Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *names: str):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql, *names) if names else sql.strip()
        return fn

    return register


_STAMPED = "created_at", "updated_at"


def _listings(spark, sf):
    s = view(spark, sf, "search_results")
    return s.withColumn("is_sponsored", F.col("is_sponsored") == 1)


# ---- upserts ------------------------------------------------------------------------------------
@query("upsert_search_results", """
SELECT asin, search_keyword, brand, search_rank, is_sponsored, is_best_seller, title FROM (
 SELECT *, CAST(NULL AS VARCHAR) AS title, row_number() OVER (PARTITION BY asin, search_keyword, brand ORDER BY seq DESC) AS n FROM search_results) WHERE n = 1""", "search_results")
def upsert_search_results(spark, sf):
    """Two batches; repeated keys within a batch and across batches keep the last row."""
    table = KeyedTable(spark, scratch_path(spark, "store"), "search_results").create()
    rows, middle = _listings(spark, sf), base(spark, sf, "orders").agg(F.expr("max(o_orderkey) div 2")).scalar()
    table.upsert(rows.where(F.col("seq") <= middle)).upsert(rows.where(F.col("seq") > middle))
    return table.read().select("asin", "search_keyword", "brand", "search_rank", "is_sponsored", "is_best_seller", "title")


@query("upsert_search_results_run_brand", """
SELECT asin, search_keyword, 'Acme' AS brand, search_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY asin, search_keyword ORDER BY seq DESC) AS n FROM search_results) WHERE n = 1""", "search_results")
def upsert_search_results_run_brand(spark, sf):
    from shelfscope.operators.filters import with_run_brand

    table = KeyedTable(spark, scratch_path(spark, "store"), "search_results").create()
    table.upsert(with_run_brand(_listings(spark, sf), "Acme"))
    return table.read().select("asin", "search_keyword", "brand", "search_rank")


@query("upsert_reviews", """
SELECT asin, review_id, brand, rating, verified_purchase, helpful_votes FROM (
 SELECT *, row_number() OVER (PARTITION BY asin, review_id, brand ORDER BY rating DESC, seq DESC) AS n FROM reviews) WHERE n = 1""", "reviews")
def upsert_reviews(spark, sf):
    """Five batches, one per rating from 1 to 5, then the parts folded into one."""
    table = KeyedTable(spark, scratch_path(spark, "store"), "reviews").create()
    rows = view(spark, sf, "reviews")
    for rating in range(1, 6):
        table.upsert(rows.where(F.col("rating") == rating))
    table.fold()
    return table.read().select("asin", "review_id", "brand", "rating", "verified_purchase", "helpful_votes")


@query("upsert_null_keys", """
SELECT asin, review_id, brand, rating FROM (
 SELECT * REPLACE (CASE WHEN rating = 3 THEN NULL ELSE '' END AS brand), row_number() OVER (PARTITION BY asin, review_id, rating = 3 ORDER BY seq DESC) AS n FROM reviews)
WHERE n = 1 OR brand IS NULL""", "reviews")
def upsert_null_keys(spark, sf):
    """A NULL brand equals nothing, so such rows are never replaced; '' is a brand like any other."""
    table = KeyedTable(spark, scratch_path(spark, "store"), "reviews").create()
    brand = F.when(F.col("rating") != 3, F.lit(""))
    table.upsert(view(spark, sf, "reviews").withColumn("brand", brand))
    return table.read().select("asin", "review_id", "brand", "rating")


@query("upsert_products", """
SELECT concat('B', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS asin, p_brand AS brand, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS title,
 p_size AS rating_5_star, CAST(0 AS INT) AS rating_4_star, CAST(7 AS INT) AS rating_1_star, '' AS bought_count, CAST(0 AS BIGINT) AS bought_count_number,
 CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS INT) AS images, CAST(p_partkey % 5 AS INT) AS ranks, CAST(0 AS INT) AS is_fba, 1 AS stamped FROM part""")
def upsert_products(spark, sf):
    from shelfscope.operators.extract_product import with_star_columns

    table = KeyedTable(spark, scratch_path(spark, "store"), "products").create()
    rows = with_star_columns(nested_products(spark, sf)).withColumn("size", F.col("rating_5_star"))
    table.upsert(rows)
    table.upsert(rows.where("size > 25").withColumn("title", F.upper("title")))
    stamped = (F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()).cast("int").alias("stamped")
    return table.read().select(
        "asin", "brand", "title", "rating_5_star", "rating_4_star", "rating_1_star", "bought_count", "bought_count_number",
        F.size("images").alias("images"), F.size("sub_category_ranks").alias("ranks"), "is_fba", stamped,
    )


_BORN = """
SELECT asin, review_id, brand, rating, strftime({0}, '%Y-%m-%d') AS created FROM (
 SELECT *, row_number() OVER (PARTITION BY asin, review_id, brand ORDER BY rating DESC, seq DESC) AS n,
  min(m) OVER (PARTITION BY asin, review_id, brand) AS born FROM
 (SELECT *, first_value(review_ts) OVER (PARTITION BY asin, review_id, brand, rating ORDER BY seq DESC) AS m FROM reviews)) WHERE n = 1"""


def _born(spark, sf, preserve):
    table = KeyedTable(spark, scratch_path(spark, "store"), "reviews", preserve_created_at=preserve).create()
    rows = view(spark, sf, "reviews").withColumn("created_at", F.col("review_ts").cast("timestamp"))
    for rating in range(1, 6):
        table.upsert(rows.where(F.col("rating") == rating))
    return table.read().select("asin", "review_id", "brand", "rating", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("replace_resets_created_at", _BORN.format("review_ts"), "reviews")
def replace_resets_created_at(spark, sf):
    return _born(spark, sf, preserve=False)


@query("replace_preserves_created_at", _BORN.format("born"), "reviews")
def replace_preserves_created_at(spark, sf):
    return _born(spark, sf, preserve=True)


@query("full_table_scan", "SELECT asin, brand, title, price, rating, rating_count FROM products", "products")
def full_table_scan(spark, sf):
    table = KeyedTable(spark, scratch_path(spark, "store"), "products").create()
    return table.upsert(view(spark, sf, "products")).read().select("asin", "brand", "title", "price", "rating", "rating_count")


def _filled(spark, sf) -> Store:
    """The four tables holding the views' rows."""
    store = Store(spark, scratch_path(spark, "store")).create()
    s, p, r = views(spark, sf)
    store["search_results"].upsert(s)
    store["products"].upsert(p)
    store["reviews"].upsert(r)
    store["scrape_tasks"].append_new(
        s.select(F.lit("product").alias("task_type"), F.col("asin").alias("target"))
    )
    return store


_STORED_S = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asin, search_keyword, brand ORDER BY seq DESC) AS n FROM search_results) WHERE n = 1)"
_STORED_R = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asin, review_id, brand ORDER BY seq DESC) AS n FROM reviews) WHERE n = 1)"
_COUNTS = f"""
SELECT 'search_results' AS table_name, count(*) AS {{0}} {{1}} FROM {_STORED_S}
UNION ALL SELECT 'products', count(*) {{1}} FROM products UNION ALL SELECT 'reviews', count(*) {{1}} FROM {_STORED_R}
UNION ALL SELECT 'scrape_tasks', count(DISTINCT asin) {{1}} FROM search_results"""


@query("table_counts", _COUNTS.format("row_count", ""), *SRP)
def stored_table_counts(spark, sf):
    store = _filled(spark, sf)
    return table_counts({n: store.read(n) for n in schemas.TABLES})


@query("table_reset", _COUNTS.format("rows_before", ", 0 AS rows_after"), *SRP)
def table_reset(spark, sf):
    return _filled(spark, sf).reset(confirm=True)


# ---- tasks --------------------------------------------------------------------------------------
@query("tasks_added_once", """
SELECT DISTINCT 'product' AS task_type, asin AS target, 'pending' AS status, 0 AS retry_count FROM search_results
UNION ALL SELECT 'review', asin, 'pending', 0 FROM products WHERE rating_count > 0""", "search_results", "products")
def tasks_added_once(spark, sf):
    s, p, _ = views(spark, sf)
    table = KeyedTable(spark, scratch_path(spark, "store"), "scrape_tasks").create()
    wanted = s.select(F.lit("product").alias("task_type"), F.col("asin").alias("target"))
    table.append_new(wanted).append_new(wanted)
    table.upsert(tasks.new_tasks(p.where("rating_count > 0").select(F.lit("review").alias("task_type"), F.col("asin").alias("target")), table.read()))
    return table.read().select("task_type", "target", "status", "retry_count")


def _task_rows(spark, sf):
    s = view(spark, sf, "search_results").groupBy("asin").agg(F.min("seq").alias("seq"))
    return s.select(
        F.lit("product").alias("task_type"), F.col("asin").alias("target"), F.lit(None).cast("string").alias("brand"),
        F.when(F.col("seq") % 3 == 0, "done").otherwise("pending").alias("status"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"), F.timestamp_seconds("seq").alias("created_at"),
        F.timestamp_seconds("seq").alias("updated_at"),
    )


@query("pending_tasks", """
WITH t AS (SELECT asin AS target, min(seq) AS seq FROM search_results GROUP BY asin)
SELECT target, seq FROM t WHERE seq % 3 <> 0 ORDER BY seq, target LIMIT 100""", "search_results")
def pending_tasks(spark, sf):
    got = tasks.pending_tasks(_task_rows(spark, sf), "product")
    return got.select("target", F.unix_seconds("created_at").alias("seq"))


@query("task_status_updates", """
WITH t AS (SELECT asin AS target, min(seq) AS seq FROM search_results GROUP BY asin),
u AS (SELECT asin AS target, seq AS at, CASE WHEN is_sponsored = 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN is_sponsored = 1 THEN 'no title' END AS error_message
 FROM search_results WHERE is_best_seller = 0 QUALIFY row_number() OVER (PARTITION BY asin ORDER BY seq DESC) = 1)
SELECT t.target, coalesce(u.status, CASE WHEN t.seq % 3 = 0 THEN 'done' ELSE 'pending' END) AS status, u.error_message,
 coalesce(u.at, t.seq) AS updated FROM t LEFT JOIN u USING (target)""", "search_results")
def task_status_updates(spark, sf):
    s, bad = view(spark, sf, "search_results").where("is_best_seller = 0"), F.col("is_sponsored") == 1
    updates = s.select(
        F.lit("product").alias("task_type"), F.col("asin").alias("target"), F.when(bad, "failed").otherwise("done").alias("status"),
        F.when(bad, "no title").alias("error_message"), F.timestamp_seconds("seq").alias("updated_at"),
    )
    got = tasks.update_status(_task_rows(spark, sf), updates)
    return got.select("target", "status", "error_message", F.unix_seconds("updated_at").alias("updated"))


# ---- record files -------------------------------------------------------------------------------
_PLAIN = ["asin", "brand", "title", "price", "rating", "rating_count"]
_PLAIN_DDL = "asin string, brand string, title string, price string, rating double, rating_count bigint"


@query("json_save_and_load", "SELECT 'saved' AS copy, asin, brand, title, price, rating, rating_count FROM products UNION ALL SELECT 'snapshot', asin, brand, title, price, rating, rating_count FROM products", "products")
def json_save_and_load(spark, sf):
    path = scratch_path(spark, "products.json")
    records.save_json(view(spark, sf, "products").select(*_PLAIN), path)
    saved = records.load_json(spark, path, _PLAIN_DDL).select(F.lit("saved").alias("copy"), "*")
    snapshot = records.load_json(spark, f"{path}_snapshots/*", _PLAIN_DDL).select(F.lit("snapshot").alias("copy"), "*")
    return saved.unionByName(snapshot)


@query("json_append", "SELECT asin, brand, title FROM products UNION ALL SELECT asin, brand, title FROM products WHERE rating > 4", "products")
def json_append(spark, sf):
    path = scratch_path(spark, "products.json")
    rows = view(spark, sf, "products")
    records.save_json(rows.select("asin", "brand", "title"), path, with_snapshot=False)
    records.append_json(rows.where("rating > 4").select("asin", "brand", "title"), path)
    return records.load_json(spark, path, "asin string, brand string, title string")


@query("json_load_missing", "SELECT asin FROM products WHERE asin = 'none'", "products")
def json_load_missing(spark, sf):
    stored = records.load_json(spark, scratch_path(spark, "nothing.json"), "asin string")
    return view(spark, sf, "products").join(stored, "asin", "left_semi").select("asin")


@query("files_by_pattern", "SELECT o_orderpriority AS keyword, count(*) AS row_count FROM orders GROUP BY 1")
def files_by_pattern(spark, sf):
    """JSON files of five folders, found by pattern among others, with their rows counted by folder."""
    path = scratch_path(spark, "found")
    rows = base(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("keyword"))
    rows.write.partitionBy("keyword").json(path)
    rows.limit(1).write.mode("append").partitionBy("keyword").csv(path)
    files = records.list_files(spark, path, "*.json").select(F.regexp_extract("file", "keyword=([^/]+)/", 1).alias("folder"))
    kept = spark.read.schema("o_orderkey bigint, keyword string").option("pathGlobFilter", "*.json").json(path)
    named = files.distinct().select(F.url_decode("folder").alias("keyword"))  # a file URL writes blanks as %20
    return kept.join(named, "keyword", "left_semi").groupBy("keyword").agg(F.count("*").alias("row_count"))


@query("csv_seed", "SELECT DISTINCT asin FROM products WHERE rating_count > 0", "products")
def csv_seed(spark, sf):
    folder = scratch_path(spark, "seed")
    records.export_csv(view(spark, sf, "products"), folder, "merged_data")
    return records.csv_seed(spark, f"{folder}/merged_data")


@query("csv_seed_without_counts", "SELECT DISTINCT asin FROM search_results", "search_results")
def csv_seed_without_counts(spark, sf):
    folder = scratch_path(spark, "seed")
    records.export_csv(view(spark, sf, "search_results"), folder, "listings")
    return records.csv_seed(spark, f"{folder}/listings")


@query("csv_export", """
SELECT concat('B', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS asin, p_brand AS brand, p_name AS title,
 '["' || p_name || '",null]' AS other, 'asin,brand,other,title' AS header FROM part""")
def csv_export(spark, sf):
    folder = scratch_path(spark, "csv")
    rows = nested_products(spark, sf).select("title", "brand", "asin", F.array("title", F.lit(None)).alias("other"))
    records.export_csv(rows, folder, "data.csv", brand="Acme")
    got = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/Acme_data.csv")
    return got.withColumn("header", F.lit(",".join(got.columns)))


@query("dataset_export", _COUNTS.format("row_count", "").replace("UNION ALL SELECT 'scrape_tasks', count(DISTINCT asin)  FROM search_results", "") + f"""
UNION ALL SELECT 'merged', count(*) FROM {_STORED_S} s LEFT JOIN products p ON s.asin = p.asin""", *SRP)
def dataset_export(spark, sf):
    """Four datasets and an empty one, which is left out."""
    store, folder = _filled(spark, sf), scratch_path(spark, "export")
    data = {n: store.read(n) for n in SRP}
    data["merged"] = merged_view(*data.values(), ordered=False)
    data["empty"] = data["products"].where("asin IS NULL")
    written = records.export_datasets(data, folder)
    return table_counts({n: spark.read.parquet(f"{folder}/data/{n}") for n in written})


_REPORT_STATS = f"SELECT table_name || '=' || row_count AS line FROM ({_COUNTS.format('row_count', '')})"


@query("analysis_report", f"""
WITH b AS ({_BRANDS.format('')} LIMIT 50),
lines AS ({_REPORT_STATS}
UNION ALL SELECT brand || ':' || product_count || ':' || total_reviews FROM b
UNION ALL SELECT 'total=' || count(*) FROM {_STORED_R}
UNION ALL SELECT 'priced=' || count(*) FROM products WHERE price <> '')
SELECT line FROM lines""", *SRP)
def analysis_report(spark, sf):
    store, folder = _filled(spark, sf), scratch_path(spark, "export")
    records.export_all(store, folder)
    report = spark.read.json(f"{folder}/analysis_report")
    stats = F.array(*[F.concat(F.lit(f"{n}="), F.col(f"stats.{n}")) for n in schemas.TABLES])
    brands = F.transform("brand_distribution", lambda b: F.concat_ws(":", b.brand, b.product_count, b.total_reviews))
    priced = F.aggregate("price_distribution", F.lit(0).cast("bigint"), lambda a, b: a + b["count"])
    rest = F.array(F.concat(F.lit("total="), "review_stats.total"), F.concat(F.lit("priced="), priced))
    return report.select(F.explode(F.concat(stats, brands, rest)).alias("line"))


@query("full_export_merged_csv", _MERGED.format(count="", on="", where="").replace("FROM search_results s", f"FROM {_STORED_S} s").replace(
    "FROM reviews r", f"FROM {_STORED_R} r"), *SRP)
def full_export_merged_csv(spark, sf):
    store, folder = _filled(spark, sf), scratch_path(spark, "export")
    path = records.export_all(store, folder)["merged"]
    merged = merged_view(*[store.read(n) for n in SRP], ordered=False).schema
    got = spark.read.option("header", True).option("escape", '"').csv(path)
    typed = got.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in merged])
    # CSV does not tell '' from a missing text; the oracle's '' comes back as NULL only where the product has it.
    known = F.col("title").isNotNull()
    return typed.withColumns(
        {
            "brand": F.when(known, F.coalesce("brand", F.lit(""))),
            "price": F.when(known & (F.substring("asin", 2, 9).cast("bigint") % 17 != 0), F.coalesce("price", F.lit(""))),
        }
    )


@query("brand_export", f"""
SELECT 'search_results' AS part, count(*) AS n FROM {_STORED_S} WHERE brand = 'Brand#3' UNION ALL SELECT 'products', count(*) FROM products WHERE brand = 'Brand#3'
UNION ALL SELECT 'reviews', count(*) FROM {_STORED_R} WHERE brand = 'Brand#3'
UNION ALL SELECT 'merged', count(*) FROM {_STORED_S} s LEFT JOIN products p ON s.asin = p.asin WHERE s.brand = 'Brand#3'
UNION ALL SELECT 'report_products', count(*) FROM products WHERE brand = 'Brand#3'
UNION ALL SELECT 'report_total_reviews', CAST(sum(rating_count) AS BIGINT) FROM products WHERE brand = 'Brand#3'""", *SRP)
def brand_export(spark, sf):
    store, folder = _filled(spark, sf), scratch_path(spark, "export")
    paths = records.export_brand(store, folder, "Brand#3")
    data = {n: spark.read.parquet(f"{paths['data']}/{n}") for n in (*SRP, "merged")}
    counts = table_counts(data).select(F.col("table_name").alias("part"), F.col("row_count").alias("n"))
    report = spark.read.json(paths["report"])
    lines = report.select(
        F.expr("stack(2, 'report_products', progress.products, 'report_total_reviews', brand_stats[0].total_reviews) AS (part, n)")
    )
    return counts.unionByName(lines)


@query("every_brand_export", """
SELECT 'products' AS part, brand, count(*) AS n FROM products GROUP BY brand
UNION ALL SELECT 'search_results', brand, count(*) FROM (SELECT DISTINCT asin, search_keyword, brand FROM search_results) GROUP BY brand
UNION ALL SELECT 'reviews', brand, count(*) FROM (SELECT DISTINCT asin, review_id, brand FROM reviews) GROUP BY brand
UNION ALL SELECT 'merged', s.brand, count(*) FROM (SELECT DISTINCT asin, search_keyword, brand FROM search_results) s LEFT JOIN products p USING (asin) GROUP BY s.brand
UNION ALL SELECT 'review_count', s.brand, sum(coalesce(c.n, 0)) FROM (SELECT DISTINCT asin, search_keyword, brand FROM search_results) s LEFT JOIN products p USING (asin)
 LEFT JOIN (SELECT asin, brand, count(*) AS n FROM (SELECT DISTINCT asin, review_id, brand FROM reviews) GROUP BY asin, brand) c ON c.asin = s.asin AND c.brand = s.brand GROUP BY s.brand""", *SRP)
def every_brand_export(spark, sf):
    store, folder = _filled(spark, sf), scratch_path(spark, "export")
    records.export_every_brand(store, folder)
    read = lambda n: spark.read.parquet(f"{folder}/{n}")
    parts = [read(n).groupBy("brand").agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "brand", "n") for n in ("products", "search_results", "reviews")]
    merged = read("merged").groupBy(F.col("search_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum("review_count").alias("counted"))
    parts += [merged.select(F.lit("merged").alias("part"), "brand", "n"), merged.select(F.lit("review_count").alias("part"), "brand", F.col("counted").alias("n"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
