"""Joins that stay even when one key holds much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above HOT_ROWS rows or one part in HOT_KEYS of all rows, whichever is more. At most HOT_KEYS keys can
# be, so the list of all of them is short at any data size, and each is cut into as many pieces as it has such shares.
HOT_ROWS = 1_000_000
HOT_KEYS = 100_000


def hot_keys(df: DataFrame, key: list[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """(key …, pieces): keys too frequent for one task and into how many pieces to cut them."""
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(min_rows), F.ceil(df.agg(F.count("*")).scalar() / HOT_KEYS)).cast("bigint")
    hot = counts.withColumn("share", share).where(F.col("n") > F.col("share")).dropna(subset=key)
    return hot.select(*key, F.ceil(F.col("n") / F.col("share")).cast("int").alias("pieces"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    how: str,
    spread_by: list[str],
    min_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on ``key``, with the left rows of hot keys cut into pieces.

    Only hot keys are copied on the right, one copy per piece; each left row meets exactly one copy, so
    the result is that of the plain join. ``spread_by`` must vary within a key. Keys are counted on
    ``counted`` where the left side's source is cheaper to read than the left side itself. Joins of one left side share a
    list counted once, ``hot``: rows of ``hot_keys`` for some of the key's columns.
    """
    key = [key] if isinstance(key, str) else key
    if hot is None:
        hot = hot_keys((left if counted is None else counted).select(*key), key, min_rows)
    on, hot = [c for c in hot.columns if c != "pieces"], F.broadcast(hot)
    pieces = F.coalesce(F.col("pieces"), F.lit(1))
    cut = left.join(hot, on, "left").withColumn("_piece", F.pmod(F.xxhash64(*spread_by), pieces)).drop("pieces")
    copied = (
        right.join(hot, on, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), (pieces - 1).cast("bigint"))))
        .drop("pieces")
    )
    return cut.join(copied, [*key, "_piece"], how).drop("_piece")


def in_work_list(rows: DataFrame, asins: DataFrame, spread_by: list[str], **hot) -> DataFrame:
    """Rows of the listed asins, for lists of any length."""
    return salted_join(rows, asins.select("asin").distinct(), "asin", "left_semi", spread_by, **hot)
