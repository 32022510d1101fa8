"""Record files: JSON, CSV and dataset exports, read and written by Spark in parallel.

A "file" of the original layout is a folder of part files here; readers take the folder.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators.flatten import flatten, with_json_text
from shelfscope.operators.merged import MERGED_ORDER, merged_per_brand, merged_view
from shelfscope.operators.stats import brand_dashboards, brand_progress, brand_stats, price_distribution, review_stats, table_counts
from shelfscope.functions import text as X
from shelfscope.session import stage
from shelfscope.sources import files
from shelfscope.sources.tables import Store

KEEP_NULLS = {"ignoreNullFields": "false"}


def run_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def save_json(df: DataFrame, path: str, with_snapshot: bool = True) -> bool:
    """Overwrite ``path`` and keep a copy under ``_snapshots/<time>``; without rows nothing is written.

    The copy is written from the saved file, so the records are computed once.
    """
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(**KEEP_NULLS).json(path)
    if with_snapshot:
        saved = df.sparkSession.read.text(path)
        saved.write.mode("overwrite").text(f"{path.rstrip('/')}_snapshots/{run_stamp()}")
    return True


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(**KEEP_NULLS).json(path)


def load_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Records of a folder this module wrote or, with ``multi_line``, of pretty-printed arrays.

    A missing path gives an empty result.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file, records-bytes) of the files below ``path`` whose name fits ``pattern``; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("file"), "length")


def csv_seed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct asins of a merged CSV; with a ``rating_count`` column only those rated at least once."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "asin" not in rows.columns:
        raise ValueError(f"no asin column in {path}")
    if "rating_count" in rows.columns:
        rows = rows.where(F.col("rating_count").try_cast("double") > 0)
    return rows.select("asin").distinct()


def csv_shape(df: DataFrame) -> DataFrame:
    """Columns sorted by name, asin first, nested values as JSON text."""
    rest = sorted(c for c in df.columns if c != "asin")
    return with_json_text(df).select(*(["asin"] if "asin" in df.columns else []), *rest)


def _named(name: str, brand: str | None) -> str:
    return f"{brand}_{name}" if brand else name


def export_csv(df: DataFrame, folder: str, name: str, brand: str | None = None) -> bool:
    if df.isEmpty():
        return False
    options = {"header": True, "escape": '"', "emptyValue": "", "nullValue": ""}
    csv_shape(df).write.mode("overwrite").options(**options).csv(f"{folder}/{_named(name, brand)}")
    return True


def export_datasets(datasets: dict[str, DataFrame], folder: str, brand: str | None = None) -> list[str]:
    """Each dataset flattened into a Parquet folder of its own; empty ones are left out."""
    written = []
    for name, df in datasets.items():
        if not df.isEmpty():
            flatten(df).write.mode("overwrite").parquet(f"{folder}/{_named('data', brand)}/{name}")
            written.append(name)
    return written


def _rows_as_list(df: DataFrame, order: str):
    """A short ranked table as one array value, sorted by the SQL expression ``order``.

    Only for results of fixed size: the top 50 brands, five price buckets, one brand.
    """
    fields = F.struct(*df.columns)
    listed = df.agg(F.array_sort(F.collect_list(F.struct(F.expr(order).alias("_at"), fields.alias("row")))).alias("rows"))
    return listed.select(F.transform("rows", lambda r: r.row)).scalar()


def report(search: DataFrame, products: DataFrame, reviews: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """One row: time, table counts, brand distribution (top 50), price distribution (five buckets), review stats."""
    tables = {"search_results": search, "products": products, "reviews": reviews}
    if tasks is not None:
        tables["scrape_tasks"] = tasks
    counts = table_counts(tables).agg(F.map_from_entries(F.collect_list(F.struct("table_name", "row_count")))).scalar()
    one = review_stats(reviews)
    return one.select(
        X.iso_now().alias("generated_at"),
        counts.alias("stats"),
        _rows_as_list(brand_stats(products), "struct(-product_count, brand)").alias("brand_distribution"),
        _rows_as_list(price_distribution(products), "cast(regexp_extract(price_range, '^[0-9]+', 0) as int)").alias(
            "price_distribution"
        ),
        F.struct(*one.columns).alias("review_stats"),
    )


def brand_report(search: DataFrame, products: DataFrame, reviews: DataFrame, brand: str) -> DataFrame:
    progress = brand_progress(search, products, reviews, brand)
    stats = brand_stats(products, limit=1, brand=brand)
    return progress.select(
        "brand",
        F.struct(*progress.columns).alias("progress"),
        _rows_as_list(stats, "brand").alias("brand_stats"),
        X.iso_now().alias("generated_at"),
    )


def export_all(store: Store, folder: str) -> dict[str, str]:
    """Every dataset, the merged CSV and the analysis report."""
    search, products, reviews = (store.read(n) for n in ("search_results", "products", "reviews"))
    merged = stage(merged_view(search, products, reviews, ordered=False))
    data = {"search_results": search, "products": products, "reviews": reviews, "merged": merged}
    export_datasets(data, folder)
    export_csv(merged.orderBy(*MERGED_ORDER), folder, "merged_data")
    report(search, products, reviews, store.read("scrape_tasks")).coalesce(1).write.mode("overwrite").options(**KEEP_NULLS).json(
        f"{folder}/analysis_report"
    )
    return {"data": f"{folder}/data", "merged": f"{folder}/merged_data", "report": f"{folder}/analysis_report"}


def export_brand(store: Store, folder: str, brand: str) -> dict[str, str]:
    """One brand's datasets, merged CSV and report."""
    search, products, reviews = (store.read(n) for n in ("search_results", "products", "reviews"))
    merged = stage(merged_view(search, products, reviews, brand=brand, ordered=False))
    own = {n: d.where(F.col("brand") == brand) for n, d in [("search_results", search), ("products", products), ("reviews", reviews)]}
    export_datasets({**own, "merged": merged}, folder, brand)
    export_csv(merged.orderBy(*MERGED_ORDER), folder, "merged_data", brand)
    brand_report(search, products, reviews, brand).write.mode("overwrite").options(**KEEP_NULLS).json(
        f"{folder}/{brand}_report"
    )
    return {"data": f"{folder}/{brand}_data", "merged": f"{folder}/{brand}_merged_data", "report": f"{folder}/{brand}_report"}


def export_every_brand(store: Store, folder: str) -> None:
    """All brands in one pass per table, one sub-folder per brand: the three tables and the merged rows; and one table of figures.

    Rebalancing by brand keeps a brand in few files and splits one that is too large for a task. Folders are named by
    the brand behind a sign of equality, so an empty brand ("=") and an unknown one ("none") stay apart; rows keep their brand.
    """
    search, products, reviews = (store.read(n) for n in ("search_results", "products", "reviews"))
    tables = {"search_results": search, "products": products, "reviews": reviews, "merged": merged_per_brand(search, products, reviews)}
    for name, table in tables.items():
        own = "search_brand" if name == "merged" else "brand"
        rows = flatten(table).withColumn("brand_folder", F.coalesce(F.concat(F.lit("="), own), F.lit("none")))
        rows.hint("rebalance", "brand_folder").write.mode("overwrite").partitionBy("brand_folder").parquet(f"{folder}/{name}")
    brand_dashboards(search, products, reviews).write.mode("overwrite").parquet(f"{folder}/figures")
