"""The task list: what is to be collected and how far it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.dedup import last_per

KEY = ["task_type", "target"]


def new_tasks(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted (task_type, target) pairs that are not listed yet, each once."""
    return wanted.select(*KEY).distinct().join(stored.select(*KEY), KEY, "left_anti")


def pending_tasks(tasks: DataFrame, task_type: str, limit: int = 100) -> DataFrame:
    waiting = tasks.where((F.col("task_type") == task_type) & (F.col("status") == "pending"))
    return waiting.orderBy("created_at", "target").limit(limit)


def update_status(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Tasks with the latest update of each key applied: its status, its error (none clears it) and its time.

    ``updates``: task_type, target, status, error_message, updated_at.
    """
    latest = last_per(updates, KEY, ["updated_at", "status"]).select(
        *KEY,
        F.struct("status", "error_message", "updated_at").alias("_new"),
    )
    joined = tasks.join(latest, KEY, "left")
    changed = F.col("_new").isNotNull()
    return joined.withColumns(
        {
            c: F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).cast(tasks.schema[c].dataType)
            for c in ("status", "error_message", "updated_at")
        }
    ).drop("_new")
