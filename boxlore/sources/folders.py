"""Folders of tables, on whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder, without Spark's own marks; empty where there is no folder."""
    fs, folder = _open(spark, path)
    if not fs.exists(folder):
        return set()
    found = {status.getPath().getName() for status in fs.listStatus(folder)}
    return {name for name in found if not name.startswith(("_", "."))}


def filled(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there that has files."""
    return bool(names(spark, path))


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the write of a table ended well."""
    fs, _ = _open(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def files_below(spark: SparkSession, path: str) -> dict[str, int]:
    """Number of files in each folder below ``path``."""
    return {name: len(names(spark, f"{path}/{name}")) for name in names(spark, path)}


def touch(spark: SparkSession, path: str) -> None:
    """An empty file that marks something as done."""
    fs, file = _open(spark, path)
    fs.create(file, True).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _open(spark, path)
    fs.delete(folder, True)
