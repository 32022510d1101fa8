"""Figures and joins that are kept up to date: each update reads what changed between two versions of a table, not the table.

A changed row takes its old part out of a figure and brings its new one in: sums over rows with a sign. What an update leaves is a part
of its own, named by the version it leads to, so an update that is repeated after a failure writes the same part again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators import merged, stats
from shelfscope.session import scratch_scope, stage
from shelfscope.sources import files
from shelfscope.sources.tables import BROADCAST_KEYS, KeyedTable, Store

MAX_PARTS = 16


# Decimals, so that what is taken out again leaves nothing behind.
_EXACT = "CAST(coalesce(rating, 0) AS DECIMAL(18, 6))"
_REVIEW_SUMS = {
    "rating_sum": _EXACT, "rating_n": "if(rating IS NULL, 0L, 1L)", "verified_count": "if(verified_purchase = 1, 1L, 0L)",
    "positive_count": "if(rating >= 4, 1L, 0L)", "negative_count": "if(rating <= 2, 1L, 0L)",
}
#: Per kept table of sums: the stored table, the keys, and what is summed besides the number of rows.
SUMS = {
    "products_by_brand": ("products", ["brand"], {
        "rating_sum": _EXACT, "rating_n": "if(rating IS NULL, 0L, 1L)", "rated_n": "if(rating <> 0, 1L, 0L)", "count_sum": "coalesce(rating_count, 0L)",
        "count_n": "if(rating_count IS NULL, 0L, 1L)", "bsr_sum": "coalesce(bsr_rank, 0L)", "bsr_n": "if(bsr_rank IS NULL, 0L, 1L)",
    }),
    "reviews_by_asin": ("reviews", ["asin"], _REVIEW_SUMS),
    "reviews_by_brand": ("reviews", ["brand"], _REVIEW_SUMS),
    "listings_by_brand": ("search_results", ["brand"], {}),
}


class KeptSums:
    """Sums over a stored table by key, as parts that add up."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root}/{name}"
        self.table, self.keys, self.sums = SUMS[name]

    def _parts(self) -> list[tuple[int, str]]:
        """(version it leads to, folder) from the last whole sum on; a folder counts once its writer is done."""
        found = sorted((int(n.split("=")[1]), n) for n in files.names(self.spark, self.path) if files.exists(self.spark, f"{self.path}/{n}/_SUCCESS"))
        whole = max((at for at, n in found if n.startswith("whole=")), default=0)
        return [(at, n) for at, n in found if n.startswith("whole=") and at == whole or n.startswith("upto=") and at > whole]

    def version(self) -> int:
        return max((at for at, _ in self._parts()), default=0)

    def _types(self) -> dict[str, str]:
        return {"n": "bigint"} | {s: "decimal(38,6)" if s == "rating_sum" else "bigint" for s in self.sums}

    def _added(self, changes: DataFrame, keys: list[str]) -> DataFrame:
        """What the changes add to each sum, by ``keys``."""
        types, sign = self._types(), F.col("change")
        sums = {"n": "1L"} | self.sums
        return changes.groupBy(*keys).agg(*(F.sum(sign * F.expr(c)).cast(types[name]).alias(name) for name, c in sums.items()))

    def _delta(self, added: DataFrame) -> DataFrame:
        """What was added by finer keys, by the own ones; keys whose sums stay are left out."""
        types = self._types()
        out = added.groupBy(*self.keys).agg(*(F.sum(name).cast(kind).alias(name) for name, kind in types.items()))
        some = F.lit(False)
        for name in types:
            some = some | (F.col(name) != 0)
        return out.where(some)

    @staticmethod
    def update_all(kept: list["KeptSums"], table: KeyedTable) -> None:
        """Take in what has changed since the last update; reads the parts written since and the folders of their keys, once for all that sum
        the same of it up to now."""
        upto, todo = table.version(), {}
        for one in kept:
            if upto > one.version():
                todo.setdefault((one.version(), tuple(one.sums.items())), []).append(one)
        for (since, _), alike in todo.items():
            spark, keys = table.spark, sorted({k for one in alike for k in one.keys})
            with scratch_scope(spark):
                added = alike[0]._added(table.changes(since, upto), keys)
                added = stage(added) if len(alike) > 1 else added
                for one in alike:
                    one._delta(added).coalesce(8).write.mode("overwrite").parquet(f"{one.path}/upto={upto:09d}")
            for one in alike:
                one._fold(upto)

    def _fold(self, upto: int) -> None:
        if len(self._parts()) > MAX_PARTS:
            self.read().write.mode("overwrite").parquet(f"{self.path}/whole={upto:09d}")

    def update(self, table: KeyedTable) -> "KeptSums":
        self.update_all([self], table)
        return self

    def read(self) -> DataFrame:
        """The sums as of the last update; keys without rows are gone."""
        types = self._types()
        schema = ", ".join([*(f"{k} string" for k in self.keys), *(f"{name} {kind}" for name, kind in types.items())])
        paths = [f"{self.path}/{n}" for _, n in self._parts()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = self.spark.read.schema(schema).parquet(*paths)
        return parts.groupBy(*self.keys).agg(*(F.sum(c).cast(kind).alias(c) for c, kind in types.items())).where("n <> 0")


def _mean(total: str, count: str) -> Column:
    return F.when(F.col(count) != 0, F.col(total).cast("double") / F.col(count))


class KeptFigures:
    """The brand and review statistics of a store, from kept sums."""

    def __init__(self, store: Store, root: str):
        self.store = store
        self.sums = {name: KeptSums(store.spark, root, name) for name in SUMS}

    def update(self) -> "KeptFigures":
        for name in sorted({kept.table for kept in self.sums.values()}):
            KeptSums.update_all([kept for kept in self.sums.values() if kept.table == name], self.store[name])
        return self

    def brand_stats(self, limit: int | None = 50) -> DataFrame:
        rows = self.sums["products_by_brand"].read().where(F.col("brand") != "").select(
            "brand", F.col("n").alias("product_count"), _mean("rating_sum", "rating_n").alias("avg_rating"),
            F.when(F.col("count_n") != 0, F.col("count_sum")).alias("total_reviews"), _mean("bsr_sum", "bsr_n").alias("avg_bsr"),
        )
        out = rows.orderBy(F.desc("product_count"), "brand")
        return out.limit(limit) if limit else out

    def review_stats_by_asin(self) -> DataFrame:
        return self.sums["reviews_by_asin"].read().select(
            "asin", F.col("n").alias("total"), _mean("rating_sum", "rating_n").alias("avg_rating"), "verified_count", "positive_count", "negative_count"
        )

    def brand_progress(self) -> DataFrame:
        long = None
        names = {"search_results": "listings_by_brand", "products": "products_by_brand", "reviews": "reviews_by_brand"}
        for part, name in names.items():
            one = self.sums[name].read().select("brand", F.lit(part).alias("part"), "n")
            long = one if long is None else long.unionByName(one)
        return long.groupBy("brand").agg(*(F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p) for p in names))

    def brand_dashboards(self) -> DataFrame:
        of_products = self.sums["products_by_brand"].read().select("brand", _mean("rating_sum", "rated_n").alias("avg_rating"), F.col("count_sum").alias("total_reviews"))
        of_reviews = self.sums["reviews_by_brand"].read().select("brand", F.col("n").alias("review_total"), "verified_count", "positive_count", "negative_count")
        return stats.dashboards_of(self.brand_progress(), of_products, of_reviews)


class KeptMerged:
    """The merged view of a store, worked out again for the asins that changed."""

    TABLES = ("search_results", "products", "reviews")

    def __init__(self, store: Store, root: str):
        self.store, self.spark, self.path = store, store.spark, f"{root}/merged"

    def _parts(self) -> list[tuple[int, list[int], str]]:
        """(number, versions of the tables it leads to, folder), in order."""
        names = [n for n in files.names(self.spark, self.path) if files.exists(self.spark, f"{self.path}/{n}/rows/_SUCCESS")]
        numbered = sorted((int(n.split("=")[1].split("-")[0]), [int(x) for x in n.split("=")[1].split("-")[1:]], n) for n in names)
        whole = max((i for i, (_, _, n) in enumerate(numbered) if n.startswith("whole=")), default=0)
        return numbered[whole:]

    def update(self) -> "KeptMerged":
        """Read of the three tables what changed, and the folders of the asins it concerns."""
        parts = self._parts()
        number, since = (parts[-1][0], parts[-1][1]) if parts else (0, [0, 0, 0])
        upto = [self.store[t].version() for t in self.TABLES]
        if upto == since:
            return self
        with scratch_scope(self.spark):
            touched = None
            for name, old, new in zip(self.TABLES, since, upto):
                asins = self.store[name].changed_keys(old, new)
                touched = asins if touched is None else touched.unionByName(asins)
            touched = stage(touched.distinct())
            path = f"{self.path}/upto={number + 1:06d}-{'-'.join(map(str, upto))}"
            touched.write.mode("overwrite").parquet(f"{path}/asins")
            search, products, reviews = (self.store[t].of_keys(touched) for t in self.TABLES)
            merged.merged_view(search, products, reviews, ordered=False).write.mode("overwrite").parquet(f"{path}/rows")
            if len(parts) + 1 > MAX_PARTS:
                whole = f"{self.path}/whole={number + 2:06d}-{'-'.join(map(str, upto))}"
                self.read().write.mode("overwrite").parquet(f"{whole}/rows")
        return self

    def read(self, ordered: bool = True) -> DataFrame:
        """Rows of each part but for asins that a later one took up; of all three tables as they were at the last update."""
        parts = [n for _, _, n in self._parts()]
        out, later = None, None
        for name in reversed(parts):
            rows = self.spark.read.parquet(f"{self.path}/{name}/rows")
            if later is not None:
                listed = later.distinct()
                rows = rows.join(F.broadcast(listed) if later.count() <= BROADCAST_KEYS else listed, "asin", "left_anti")
            out = rows if out is None else out.unionByName(rows)
            if files.exists(self.spark, f"{self.path}/{name}/asins"):
                asins = self.spark.read.parquet(f"{self.path}/{name}/asins")
                later = asins if later is None else later.unionByName(asins)
        if out is None:
            out = merged.merged_view(*(self.store.read(t).limit(0) for t in self.TABLES), ordered=False)
        return out.orderBy(*merged.MERGED_ORDER) if ordered else out
