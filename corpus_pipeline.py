"""From raw documents to packed training windows: the stages in order, each on all that the one before it kept.

Every stage but the last returns the columns of ``documents``. Between stages the rows pass through Parquet in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import decontaminate, packing, pii, simhash_dedup, toxicity
from shelfscope.llm.common import table, without_ids
from shelfscope.session import scratch_scope, stage, staged_alone


#: Documents that go to a Python worker at once: texts are long, and both ends of the pipe hold a batch.
BATCH_ROWS = 1_000
_ROW = "_row_key"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """A session that wants still shorter batches keeps them."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model learns from the labelled ones among ``docs``."""
    _short_batches(spark)
    with scratch_scope(spark):
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest id."""
    _short_batches(spark)
    return simhash_dedup.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. A row is told by its id and its text, so others that share its id, or have none, stay."""
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.length("text"), F.lit(-1)), F.xxhash64("text"), F.hash("text"))
    keyed = docs.withColumn(_ROW, own)
    found = staged_alone(spark, lambda: decontaminate.find(keyed, table(spark, sf_dir, "benchmark"), id_col=_ROW).select("doc_id").distinct())
    return without_ids(keyed, found, _ROW).drop(_ROW)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; all documents stay, with their new lengths."""
    _short_batches(spark)
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Fitted scores, fingerprints and packing are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
