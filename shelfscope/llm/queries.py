"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import ann, conversations, decontaminate, hard_negatives, license_scan, mixing, packing, pii, secret_scan, sharding, simhash_dedup, token_files, toxicity
from shelfscope.llm.common import table
from shelfscope.llm.oracles import ORACLES  # noqa: F401
from shelfscope.session import scratch_path

#: The shards that documents are placed on.
SHARDS = [f"shard-{i:02d}" for i in range(64)]


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    return secret_scan.report(*secret_scan.scan(table(spark, sf_dir, "documents")))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.scan(table(spark, sf_dir, "documents")))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither copies nor near copies share a bin."""
    rows = packing.clustered(table(spark, sf_dir, "documents"))
    return packing.pack(rows, length=F.col("n"), cluster=F.col("cluster"))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path, ids=False)


def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % ann.QUERY_EVERY == 0)


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, dropped)


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"), label=hard_negatives.relabelled())
    return hard_negatives.mine(rows, F.col("vec_id") % hard_negatives.ANCHOR_EVERY == 0)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": license_query,
    "op2_secret_scan": secrets_query,
    "op3_pii": pii_query,
    "op4_packing": packing_query,
    "op5_decontamination": decontamination_query,
    "op6_token_files": token_files_query,
    "op7_simhash_dedup": near_duplicates_query,
    "op8_toxicity": toxicity_query,
    "op9_sharding": sharding_query,
    "op10_neighbours": neighbours_query,
    "op11_conversation_repair": conversations_query,
    "op12_hard_negatives": hard_negatives_query,
    "op13_mixing": mixing_query,
}
