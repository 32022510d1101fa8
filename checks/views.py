"""Product, listing and review tables derived from the driver's tables.

One SQL text per view, valid in Spark and in DuckDB, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "products": """
SELECT concat('B', lpad(cast(p_partkey AS string), 9, '0')) AS asin,
 CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_brand END AS brand, p_name AS title,
 CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN 'Currently unavailable'
      WHEN (p_partkey * 7) % 1300 >= 1000 THEN concat('$1,', lpad(cast((p_partkey * 7) % 1300 - 1000 AS string), 3, '0'), '.99')
      ELSE concat('$', cast((p_partkey * 7) % 260 AS string), '.99') END AS price,
 CASE WHEN p_size % 10 = 0 THEN NULL ELSE cast(10 + p_partkey % 41 AS double) / 10 END AS rating,
 CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE (p_partkey * 37) % 5001 END AS rating_count,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey * 101) % 99991 + 1 END AS bsr_rank,
 p_type AS bsr_category, cast(p_size % 2 AS int) AS is_fba, cast(p_size % 3 = 0 AS int) AS has_aplus,
 CASE WHEN p_partkey % 3 = 0 THEN 'Amazon.com' ELSE concat('Seller ', cast(p_size AS string)) END AS seller,
 concat('March ', cast(p_partkey % 28 + 1 AS string), ', ', cast(2000 + p_partkey % 24 AS string)) AS first_available
FROM part""",
    "reviews": """
SELECT concat('B', lpad(cast(l_partkey AS string), 9, '0')) AS asin,
 CASE WHEN l_partkey % 31 = 0 THEN '' ELSE concat('Brand#', cast(l_partkey % 25 + 1 AS string)) END AS brand,
 concat('R', lpad(cast(l_orderkey AS string), 9, '0'), cast(l_linenumber AS string)) AS review_id,
 cast(l_quantity AS int) % 5 + 1 AS rating, cast(l_linestatus = 'F' AS int) AS verified_purchase,
 cast(l_quantity AS int) % 7 AS helpful_votes, l_shipdate AS review_ts, l_extendedprice AS seq
FROM lineitem""",
    "search_results": """
SELECT concat('B', lpad(cast(o_custkey * 2 AS string), 9, '0')) AS asin, o_orderpriority AS search_keyword,
 o_orderkey % 4800 + 1 AS search_rank, o_orderkey AS seq,
 CASE WHEN o_custkey % 31 = 0 THEN '' ELSE concat('Brand#', cast(o_custkey % 25 + 1 AS string)) END AS brand,
 cast(o_orderstatus = 'F' AS int) AS is_sponsored, cast(o_orderpriority = '1-URGENT' AS int) AS is_amazon_choice,
 cast(o_orderstatus = 'P' AS int) AS is_best_seller
FROM orders""",
}
_BASES = {"products": "part", "reviews": "lineitem", "search_results": "orders"}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = _BASES[name]
    sql = VIEWS[name].replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(sql, **{table: base(spark, sf_dir, table)})


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search results, products, reviews."""
    return tuple(view(spark, sf_dir, n) for n in ("search_results", "products", "reviews"))


def oracle(body: str, *names: str) -> str:
    """``body`` with the named views in front of it."""
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over every task slot: the small test files are one scan split each, a cluster's are not."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)
