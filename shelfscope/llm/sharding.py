"""Placement of rows on shards by a lookup table that shards fill in turns.

Each shard has its own order of preference over the slots of a table of prime size: a first slot and a step, both hashed from its
name, visit every slot once. Shards take turns; at its turn a shard claims the first free slot it prefers, until none is free. All
shards get the same number of slots but for one, and when a shard comes or goes, few slots change hands. The table's size is fixed, so
its broadcast has a proven bound, and placing a row is one hash and one look into it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table; a prime, well above a hundred times the number of shards.
SLOTS = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order; a prime number of slots makes any step visit all of them."""
    return _number(f"first:{shard}") % slots, _number(f"step:{shard}") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its number in the list) of each slot. Names must differ; fewer shards than slots are needed."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("give one to as many different shards as there are slots, and a prime number of slots")
    orders = [preference(s, slots) for s in shards]
    at = [first for first, _ in orders]
    owner, free = [-1] * slots, slots
    while True:
        for number, (_, step) in enumerate(orders):
            while owner[at[number]] >= 0:
                at[number] = (at[number] + step) % slots
            owner[at[number]] = number
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hex digits of its MD5, as a number, modulo the table's size. A null key has the slot of an empty one."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def table_rows(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame(list(zip(range(slots), (shards[i] for i in lookup_table(shards, slots)))), "slot int, shard string")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for each row; repeated rows repeat, other columns are not read."""
    keyed = rows.select(F.col(key), slot_of(F.col(key), slots).alias("slot"))
    return keyed.join(F.broadcast(table_rows(rows.sparkSession, shards, slots)), "slot").select(key, "slot", "shard")


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, pieces: int = 8, slots: int = SLOTS) -> None:
    """``rows`` with all columns below ``path``, a folder ``_shard=…`` per shard, each written by several tasks so that no task holds a shard."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(zip(range(slots), (shards[i] for i in lookup_table(shards, slots)))), "_slot int, _shard string")
    dealt = rows.withColumn("_at", slot_of(F.col(key), slots)).join(F.broadcast(names), F.col("_at") == F.col("_slot")).drop("_at", "_slot")
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(pieces))
    dealt.repartition("_shard", spread).write.partitionBy("_shard").parquet(path)
