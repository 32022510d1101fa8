"""File names and small files on whatever file system a path names (local, HDFS, object store)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything a path pattern names, is there."""
    fs, target = _open(spark, path)
    return bool(fs.globStatus(target))


def names(spark: SparkSession, path: str) -> list[str]:
    """Entries directly below ``path``."""
    fs, target = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes below ``path``."""
    fs, target = _open(spark, path)
    return fs.getContentSummary(target).getLength()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file whole; a file already there is an error."""
    fs, target = _open(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _open(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _open(spark, path)
    fs.delete(target, True)
