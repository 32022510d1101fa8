"""Product pages to one product row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import schemas
from shelfscope.functions import numbers as N
from shelfscope.functions import text as X
from shelfscope.sources.candidates import read_candidates

# Fixed values.
LIST_LIMIT = 10
DESCRIPTION_CHARS = 2000
SMALL_TO_LARGE = [("_SS40_", "_SL1500_"), ("_AC_US40_", "_AC_SL1500_")]
NOT_A_PHOTO = ["sprite", "grey-pixel"]
OWN_SELLER = "Amazon.com"
STAR = r"(?U)(\d)"
STAR_NAMED = r"(?iU)(\d)\s*star"
STAR_AND_SHARE = r"(?iUd)(\d)\s*star.*?(\d+)%"
SHARE = r"(?U)(\d+)%"
RANK_IN = r"(?U)#?([\d,]+)\s+in\s+"
RANK_IN_CATEGORY = r"(?U)#?([\d,]+)\s+in\s+([^()\n]+)"
BOUGHT_WORD = "bought"
BOUGHT_IN_SOURCE = r"(?iU)>(\d+[KkMm]?\+?\s*bought\s+in\s+past\s+month)<"


def _matched(values: Column) -> Column:
    """Text of the first selector that matched, even when that text is empty."""
    return F.coalesce(X.first_present(values), F.lit(""))


def _written(values: Column) -> Column:
    """First text that is not empty."""
    return F.coalesce(X.first_text(values), F.lit(""))


def _star_shares(pairs: Column) -> Column:
    """(star, share) pairs to a map of ``<star>_star``; of two shares for one star the later counts."""
    full = F.filter(pairs, lambda p: p.star.isNotNull() & p.share.isNotNull())
    stars = F.array_distinct(F.transform(full, lambda p: p.star))
    entries = F.transform(
        stars,
        lambda s: F.struct(
            F.concat(s, F.lit("_star")), F.try_element_at(F.filter(full, lambda p: p.star == s), F.lit(-1)).share
        ),
    )
    return F.map_from_entries(entries)


def _share(text: Column) -> Column:
    return X.extract(text, SHARE).try_cast("int")


def rating_distribution(found: Column) -> Column:
    rows = F.transform(
        found.star_rows,
        lambda r: F.struct(X.extract(r.star, STAR).alias("star"), _share(r.share).alias("share")),
    )
    labels = F.transform(
        found.star_labels,
        lambda t: F.struct(
            X.extract(t, STAR_AND_SHARE).alias("star"), X.extract(t, STAR_AND_SHARE, 2).try_cast("int").alias("share")
        ),
    )
    bars = F.transform(
        found.star_bars,
        lambda t: F.struct(X.extract(t, STAR_NAMED).alias("star"), _share(t).alias("share")),
    )
    first, second, third = _star_shares(rows), _star_shares(labels), _star_shares(bars)
    return F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(third)


def _bought_text(found: Column) -> Column:
    return F.coalesce(
        X.first_where(found.bought, lambda t: X.mentions(t, BOUGHT_WORD)),
        F.get(found.bought_spans, F.lit(0)),
        F.col("bought_in_source"),
        F.lit(""),
    )


def sales_rank(rows: Column) -> Column:
    """(rank, category) of the first row that names a readable rank."""
    ranks = F.transform(
        rows,
        lambda t: F.struct(
            N.comma_integer(X.extract(t, RANK_IN_CATEGORY)).alias("rank"), X.strip(X.extract(t, RANK_IN_CATEGORY, 2)).alias("category")
        ),
    )
    return X.first_where(ranks, lambda r: r.rank.isNotNull())


def sub_category_ranks(links: Column) -> Column:
    ranked = F.transform(
        links,
        lambda k: F.struct(
            N.comma_integer(X.extract(k.context, RANK_IN)).alias("rank"),
            k.category.alias("category"),
            k.url.alias("url"),
        ),
    )
    kept = F.filter(ranked, lambda r: (r.rank != 0) & (r.category != ""))
    kind = f"array<{schemas.RANK}>"
    return F.aggregate(
        kept.cast(kind),
        F.array().cast(kind),
        lambda seen, r: F.when(
            F.exists(seen, lambda s: (s.rank == r.rank) & (s.category == r.category)), seen
        ).otherwise(F.array_append(seen, r)),
    )


def bullet_points(groups: Column) -> Column:
    long_enough = F.transform(groups, lambda g: F.array_distinct(F.filter(g, lambda t: F.length(t) > 5)))
    chosen = X.first_where(long_enough, lambda g: F.size(g) > 0)
    return F.slice(F.coalesce(chosen, F.array().cast("array<string>")), 1, LIST_LIMIT)


def _enlarged(src: Column) -> Column:
    out = src
    for small, large in reversed(SMALL_TO_LARGE):
        out = F.when(F.contains(src, F.lit(small)), F.replace(src, F.lit(small), F.lit(large))).otherwise(out)
    return out


def _is_photo(src: Column) -> Column:
    ok = src != ""
    for word in NOT_A_PHOTO:
        ok = ok & ~F.contains(src, F.lit(word))
    return ok


def image_urls(found: Column) -> Column:
    photos = F.filter(found.images, _is_photo)
    photos = F.array_distinct(F.transform(photos, _enlarged))
    main = F.coalesce(F.array_distinct(F.json_object_keys(found.main_image)), F.array().cast("array<string>"))
    return F.slice(F.when(F.size(photos) > 0, photos).otherwise(main), 1, LIST_LIMIT)


def variants(found: Column) -> Column:
    kept = F.filter(found.variants, lambda v: (v.asin != "") | (v.value != ""))
    return F.transform(
        kept,
        lambda v: F.struct(
            v.asin.alias("asin"),
            v.value.alias("value"),
            (~F.array_contains(v.classes, "unavailable")).alias("available"),
        ),
    )


def _seller(found: Column) -> Column:
    own = F.when(F.contains(found.merchant, F.lit(OWN_SELLER)), F.lit(OWN_SELLER))
    return F.coalesce(X.first_text(found.seller), own, F.lit(""))


def _is_fba(found: Column) -> Column:
    return X.flag(found.prime | F.coalesce(F.exists(found.delivery, lambda t: X.mentions(t, "amazon")), F.lit(False)))


def products(pages: DataFrame) -> DataFrame:
    """One row per readable page with a title; ``rating_distribution`` is still a map here."""
    sourced = pages.withColumn("bought_in_source", X.extract(F.col("html"), BOUGHT_IN_SOURCE))
    found = F.col("found")
    rank = sales_rank(found.sales_rank_rows)
    bought = _bought_text(found)
    carried = [c for c in pages.columns if c not in ("html", "asin", "brand", "url", "keyword")]
    rows = read_candidates(sourced, "product").where(found.isNotNull()).select(
        *carried,
        "asin",
        _matched(found.title).alias("title"),
        X.clean_brand(_matched(found.brand)).alias("brand"),
        _matched(found.price).alias("price"),
        _matched(found.original_price).alias("original_price"),
        X.first_present(F.transform(found.rating, N.rating_value)).alias("rating"),
        N.first_comma_integer(F.get(found.rating_count, F.lit(0))).alias("rating_count"),
        rating_distribution(found).alias("rating_distribution"),
        bought.alias("bought_count"),
        N.bought_number(bought).alias("bought_count_number"),
        rank.rank.alias("bsr_rank"),
        F.coalesce(rank.category, F.lit("")).alias("bsr_category"),
        sub_category_ranks(found.sub_ranks).alias("sub_category_ranks"),
        bullet_points(found.bullets).alias("bullet_points"),
        X.truncated(_written(found.description), DESCRIPTION_CHARS).alias("description"),
        image_urls(found).alias("images"),
        variants(found).alias("variants"),
        _seller(found).alias("seller"),
        _is_fba(found).alias("is_fba"),
        X.flag(found.aplus).alias("has_aplus"),
        F.coalesce(X.first_present(F.transform(found.date_rows, X.available_date)), F.lit("")).alias("first_available"),
        _matched(found.availability).alias("availability"),
    )
    return rows.where(F.col("title") != "")


def with_star_columns(rows: DataFrame) -> DataFrame:
    """The rating map as five columns, 0 where a star is missing."""
    shares = F.col("rating_distribution")
    return rows.select(
        "*", *[X.lookup(shares, f"{n}_star").alias(f"rating_{n}_star") for n in (5, 4, 3, 2, 1)]
    ).drop("rating_distribution")
