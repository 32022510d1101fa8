"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from shelfscope.sources import files

CHECKPOINT_DIR = "spark.checkpoint.dir"
_staged: list[str] = []


def local_session(name: str = "shelfscope", cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_single_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. A single-machine session may do without one; a cluster may not."""
    try:
        root = spark.conf.get(CHECKPOINT_DIR)
    except PySparkException:
        root = None
    root = root or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_single_machine(spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="shelfscope-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What several passes read is computed once, and a lost executor costs a re-read instead of the
    upstream work. Parquet rather than ``checkpoint()``, so later passes still prune columns and
    push filters down.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside. No result that reads it may outlive the block."""
    first = len(_staged)
    try:
        yield
    finally:
        while len(_staged) > first:
            files.remove(spark, _staged.pop())


def staged_alone(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``stage`` for a result that needs staged steps of its own: those are deleted once it is written."""
    first = len(_staged)
    out = stage(build())
    own = _staged.pop()
    while len(_staged) > first:
        files.remove(spark, _staged.pop())
    _staged.append(own)
    return out


def release_staged(spark: SparkSession) -> None:
    """Delete what ``stage`` wrote, once no result built on it is needed any more."""
    while _staged:
        files.remove(spark, _staged.pop())
