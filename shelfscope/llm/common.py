"""What several operators of this folder share."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of two or three narrow columns that are ever sent to all executors (some tens of MB). Sides are counted first;
#: a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A key is hot if it holds more than the first share of the rows, or more than so many rows and the second share: at most 1,000 hot keys
#: up to 10^8 rows, and at most 100,000 at any size. No task joins more than 100,000 rows of a key up to 10^10 rows.
HOT_SHARE, HOT_ROWS, LEAST_SHARE = 0.001, 100_000, 0.00001


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers of a session, once, so that they can import it wherever they run.

    The archive is served by the driver, as Spark serves any Python file.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/shelfscope", "zip", root, "shelfscope"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to hold at most ``bound`` rows. It must be cheap to count."""
    return F.broadcast(df) if df.count() <= bound else df


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is none of ``ids`` (one column); all columns stay, a null id equals a null id."""
    listed = side(ids.select(F.col(ids.columns[0]).alias("_listed")).distinct())
    return docs.join(listed, docs[id_col].eqNullSafe(listed["_listed"]), "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is one of ``ids``."""
    listed = side(ids.select(F.col(ids.columns[0]).alias("_listed")).distinct())
    return docs.join(listed, docs[id_col].eqNullSafe(listed["_listed"]), "left_semi")


def look_up(rows: DataFrame, facts: DataFrame, key: str, held: str) -> DataFrame:
    """Left join of ``rows`` with one row of ``facts`` per key, whatever share of the rows one key holds.

    ``held`` is the column of ``facts`` that counts a key's rows. Facts of hot keys, at most ``1 / LEAST_SHARE`` of them, are
    broadcast; rows of all other keys are shuffled. ``key`` holds no nulls in ``facts``; rows without facts get nulls.
    """
    total = facts.agg(F.sum(held)).first()[0] or 0
    facts = facts.withColumn("_hot", F.col(held) > F.lit(min(HOT_SHARE * total, max(HOT_ROWS, LEAST_SHARE * total))))
    names = [c for c in facts.columns if c not in (key, "_hot")]
    hot = facts.where("_hot").select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_is_hot"))
    met = rows.join(F.broadcast(hot), rows[key] == hot["_key"], "left").drop("_key")
    easy = met.where("_is_hot").select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in names))
    rest = met.where("_is_hot IS NULL").select(*rows.columns)
    return easy.unionByName(rest.join(facts.where("NOT _hot").drop("_hot"), key, "left").select(*rows.columns, *names))


def span_key(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))
