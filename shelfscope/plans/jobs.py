"""The composite jobs: stored pages in, stored tables and exports out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.operators import extract_product, extract_review, extract_search, filters, merged, paging, stats
from shelfscope.operators.dedup import first_listing, newest_page
from shelfscope.operators.joins import in_work_list
from shelfscope.operators.membership import likely_in
from shelfscope.operators.quality import is_blocked, is_captcha, is_refused
from shelfscope.operators.ranking import top_for_review
from shelfscope.schemas import PAGE_BUCKET
from shelfscope.session import scratch_scope, stage
from shelfscope.sources import records
from shelfscope.sources.pages import BUCKETS, page_bucket
from shelfscope.sources.tables import Store

# Work lists up to this many asins are written into the scan's filter, where Parquet skips row groups by them.
LITERAL_ASINS = 1_000


@dataclass
class Settings:
    """Options of a run. ``filter_by_brand`` off means every brand passes."""

    filter_by_brand: bool = False
    target_brands: list[str] = field(default_factory=list)
    brand_match_mode: str = "contains"
    search_pages: int = paging.SEARCH_PAGES
    review_pages: int = paging.REVIEW_PAGES
    reviews_top_n: int = 50
    min_reviews: int = 100

    def targets(self, run_brand: str) -> list[str]:
        return [run_brand] if run_brand else self.target_brands


def _of_kind(pages: DataFrame, kind: str) -> DataFrame:
    return pages.where(F.col("page_kind") == kind).drop(PAGE_BUCKET)


def pages_of(pages: DataFrame, asins: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The pages that a work list of any length is likely to mean; all those it means are among them.

    A page store laid out by asin is read in the folders of the listed asins only. Of these, a short list picks row groups by the asins
    themselves, and a membership filter of bounded size the pages that are worth parsing. No page HTML is shuffled.
    """
    asins = asins.select("asin").where("asin IS NOT NULL")
    if PAGE_BUCKET in pages.columns:
        numbers = asins.select(page_bucket(F.col("asin"), buckets).alias("n")).distinct().collect()  # at most as many as folders
        pages = pages.where(F.col(PAGE_BUCKET).isin(sorted(r["n"] for r in numbers)))
    short = [r["asin"] for r in asins.limit(LITERAL_ASINS + 1).collect()]
    if len(short) <= LITERAL_ASINS:
        return pages.where(F.col("asin").isin(short))
    return likely_in(pages, asins, "asin", asins.count())


def for_asins(pages: DataFrame, asins: DataFrame, extract) -> DataFrame:
    """``extract`` applied to the pages of a work list. Pages that a membership filter let through by chance go when rows are extracted."""
    asins = stage(asins.select("asin").distinct())
    likely = pages_of(pages, asins)
    return in_work_list(extract(likely), asins, ["page_id"], counted=likely)


# ---- search -----------------------------------------------------------------------------------
def search_rows(pages: DataFrame, settings: Settings, keywords: list[str] | None = None) -> DataFrame:
    """All items of the pages that count, and the ``faults`` of those pages."""
    pages = _of_kind(pages, "search")
    if keywords:
        ordinal = F.create_map(*[v for n, k in enumerate(keywords) for v in (F.lit(k), F.lit(n))])
        pages = pages.where(F.col("keyword").isin(keywords)).withColumn("keyword_ord", ordinal[F.col("keyword")])
    html = F.col("html")
    capped = paging.page_cap(pages, settings.search_pages).withColumns({"captcha": is_captcha(html), "sorry": is_blocked(html)})
    read = extract_search.search_candidates(capped)
    # A page that lists anything was not refused, whatever its titles say.
    read = read.withColumn("refused", F.col("captcha") | (F.col("sorry") & (F.coalesce(F.size("items"), F.lit(0)) <= 0))).drop("captcha", "sorry")
    # A refused page neither ends its keyword nor stands in the way of an older good copy; nor does one that cannot be read.
    read = read.withColumns({"has_next": F.col("has_next") | F.col("refused"), "bad": F.col("refused") | F.col("items").isNull()})
    current = newest_page(read, ["keyword", "page_no"], bad="bad").where(~F.col("refused")).drop("refused", "bad")
    return extract_search.search_items(paging.until_last_page(current), keep_faults=True)


def _target_listings(rows: DataFrame, settings: Settings, run_brand: str) -> tuple[DataFrame, Column]:
    hit = filters.is_target_brand(F.col("brand"), settings.targets(run_brand), settings.brand_match_mode, settings.filter_by_brand)
    return rows.where(F.length("asin") == extract_search.ASIN_LENGTH).drop("faults"), hit


def search_listings(pages: DataFrame, settings: Settings, run_brand: str = "", keywords: list[str] | None = None) -> DataFrame:
    """First listings of target brands."""
    items, hit = _target_listings(search_rows(pages, settings, keywords), settings, run_brand)
    return filters.with_run_brand(first_listing(items.where(hit)), run_brand)


def fault_rows(rows: DataFrame, carried: list[str]) -> DataFrame:
    """(…, pos, kind): one row per item or page that could not be read, from rows with ``faults``."""
    return rows.where(F.size("faults") > 0).select(*carried, F.explode("faults").alias("fault")).select(*carried, "fault.pos", "fault.kind")


def _save_faults(rows: DataFrame, carried: list[str], path: str) -> None:
    fault_rows(rows, carried).write.mode("overwrite").parquet(path)


def run_search(
    pages: DataFrame, store: Store, folder: str, settings: Settings, run_brand: str = "", keywords: list[str] | None = None
) -> DataFrame:
    """Besides the listings, ``search_outcome`` holds how many items the brand filter kept and rejected and how many were unreadable,
    ``search_faults`` which these are."""
    rows = stage(search_rows(pages, settings, keywords))
    items, hit = _target_listings(rows, settings, run_brand)
    found = stage(filters.with_run_brand(first_listing(items.where(hit)), run_brand))
    faults = rows.agg(F.coalesce(F.sum(F.when(F.size("faults") > 0, F.size("faults"))), F.lit(0)).alias("faults"))
    counts = items.agg(F.count_if(hit).alias("kept"), F.count_if(~hit).alias("rejected"))
    counts.crossJoin(faults).write.mode("overwrite").json(f"{folder}/search_outcome")  # two single rows
    _save_faults(rows, ["page_id", "page_no", "search_keyword"], f"{folder}/search_faults")
    store["search_results"].upsert(found)
    records.save_json(found.drop("page_id", "page_kind", "keyword_ord", "page_no", "pos", "fetched_at"), f"{folder}/search_results.json")
    return found


# ---- products ---------------------------------------------------------------------------------
def product_details(pages: DataFrame, settings: Settings, run_brand: str = "") -> DataFrame:
    """The newest page with a title per asin, then the brand filter."""
    rows = newest_page(extract_product.products(_of_kind(pages, "product")), ["asin"])
    return filters.keep_run_brand(rows, run_brand, settings.brand_match_mode, settings.filter_by_brand)


def run_products(
    pages: DataFrame,
    store: Store,
    folder: str,
    settings: Settings,
    run_brand: str = "",
    asins: DataFrame | None = None,
) -> DataFrame:
    """Listed asins without a product, or the given ones."""
    if asins is None:
        asins = merged.pending_products(store.read("search_results"), store.read("products"))
    asins = stage(asins.select("asin").distinct())
    rows = for_asins(pages, asins, lambda some: product_details(some, settings, run_brand))
    found = stage(filters.with_run_brand(rows, run_brand).drop("page_id", "page_kind", "keyword_ord", "page_no", "fetched_at"))
    store["products"].upsert(extract_product.with_star_columns(found))
    records.save_json(found, f"{folder}/products.json")
    stats.outcomes(asins, found).write.mode("overwrite").parquet(f"{folder}/product_outcomes")
    return found


# ---- reviews ----------------------------------------------------------------------------------
def review_page_candidates(pages: DataFrame, cap: int) -> DataFrame:
    """One narrow row per readable page position: candidates, and whether the page ends its product's run."""
    html = F.col("html")
    capped = paging.page_cap(_of_kind(pages, "review"), cap).select(
        "page_id", "asin", "page_no", "fetched_at", "html", is_captcha(html).alias("captcha"), is_refused(html).alias("sorry")
    )
    read = extract_review.review_candidates(capped)
    # A page with reviews was not refused: the product may be called "Sorry".
    refused = F.col("captcha") | (F.col("sorry") & (F.coalesce(F.size("items"), F.lit(0)) <= 0))
    return read.withColumn("bad", refused | F.col("unreadable")).drop("captcha", "sorry", "unreadable")


def review_page_rows(candidates: DataFrame) -> DataFrame:
    """Reviews of the copy that counts of each page, staged, with the ``faults`` of those pages."""
    return stage(extract_review.review_rows(newest_page(candidates, ["asin", "page_no"], bad="bad"), keep_empty_pages=True))


def reviews_of_rows(rows: DataFrame, cap: int, run_brand: str = "") -> DataFrame:
    kept = paging.cut_review_pages(rows.drop("faults"), cap)
    return kept.withColumn("brand", F.lit(run_brand)).drop("page_id", "fetched_at", "page_no", "pos", "review_date")


def reviews_of_candidates(candidates: DataFrame, cap: int, run_brand: str = "") -> DataFrame:
    return reviews_of_rows(review_page_rows(candidates), cap, run_brand)


def run_reviews(
    pages: DataFrame,
    store: Store,
    folder: str,
    settings: Settings,
    run_brand: str = "",
    asins: DataFrame | None = None,
) -> DataFrame:
    """The most-rated products, or the given asins, minus those whose reviews are stored.

    ``review_outcomes`` tells of each whether it gave reviews, ``review_faults`` what could not be read.
    """
    if asins is None:
        asins = top_for_review(store.read("products"), settings.reviews_top_n)
    todo = merged.resume_reviews(asins, store.read("reviews"), settings.min_reviews)
    cap = settings.review_pages
    todo = stage(todo.select("asin").distinct())
    rows = review_page_rows(for_asins(pages, todo, lambda some: review_page_candidates(some, cap)))
    found = stage(reviews_of_rows(rows, cap, run_brand))
    store["reviews"].upsert(found)
    records.save_json(found, f"{folder}/reviews_new.json")
    stats.outcomes(todo, found).write.mode("overwrite").parquet(f"{folder}/review_outcomes")
    _save_faults(rows, ["page_id", "asin", "page_no"], f"{folder}/review_faults")
    return found


# ---- whole runs -------------------------------------------------------------------------------
def run_all(pages: DataFrame, store: Store, folder: str, settings: Settings, keywords: list[str] | None = None) -> DataFrame:
    with scratch_scope(pages.sparkSession):
        run_search(pages, store, folder, settings, keywords=keywords)
        run_products(pages, store, folder, settings)
        run_reviews(pages, store, folder, settings)
        records.export_all(store, folder)
    return stored_stats(store)


def run_brand_stage(
    pages: DataFrame,
    store: Store,
    folder: str,
    settings: Settings,
    brand: str,
    stage_name: str,
    keywords: list[str] | None = None,
) -> DataFrame:
    """One brand through one stage, then that brand's export and figures."""
    with scratch_scope(pages.sparkSession):
        if stage_name == "search":
            run_search(pages, store, folder, settings, brand, keywords)
        elif stage_name == "products":
            run_products(pages, store, folder, settings, brand)
        elif stage_name == "reviews":
            run_reviews(pages, store, folder, settings, brand)
        else:
            raise ValueError(f"no such stage: {stage_name}")
        records.export_brand(store, folder, brand)
    return stored_stats(store, brand)


def run_reviews_from_csv(pages: DataFrame, store: Store, folder: str, settings: Settings, csv_path: str) -> DataFrame:
    """The reviews found stay staged for the caller; what the export staged does not."""
    seed = records.csv_seed(pages.sparkSession, csv_path)
    found = run_reviews(pages, store, folder, settings, asins=seed)
    with scratch_scope(pages.sparkSession):
        records.export_all(store, folder)
    return found


def stored_stats(store: Store, brand: str | None = None) -> DataFrame:
    search, products, reviews = (store.read(n) for n in ("search_results", "products", "reviews"))
    if brand:
        return stats.brand_dashboards(search, products, reviews, brand)
    return stats.dashboard(search, products, reviews, store.read("scrape_tasks"))


def export(store: Store, folder: str, brand: str | None = None) -> dict[str, str]:
    return records.export_brand(store, folder, brand) if brand else records.export_all(store, folder)
