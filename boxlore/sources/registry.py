"""What was imported before, and which version of a file is in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def new_files(files: DataFrame, registry: DataFrame | None, order: str = "path") -> DataFrame:
    """Files whose content was neither imported before nor occurs earlier in the batch.

    Winners are settled on the narrow hash column; the contents are only
    filtered by the result and never shuffled."""
    first = files.groupBy("file_hash").agg(F.min(order).alias(order))
    if registry is not None:
        first = first.join(registry.select("file_hash"), "file_hash", "left_anti")
    return files.join(first.select(order), order, "left_semi")


def imports(files: DataFrame, registry: DataFrame | None, run_time) -> DataFrame:
    """Registry rows to append: one per new content hash, first name wins."""
    named = files.groupBy("file_hash").agg(F.min("file_name").alias("file_name"))
    if registry is not None:
        named = named.join(registry.select("file_hash"), "file_hash", "left_anti")
    return named.select("file_name", "file_hash", run_time.alias("import_date"))


def version_status(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Per file the version in use, the highest version, and the status.

    ``files`` has (file_name, md5), ``versions`` (file_name, md5, version_number)."""
    highest = versions.groupBy("file_name").agg(F.max("version_number").alias("highest"))
    in_use = versions.groupBy("file_name", "md5").agg(F.max("version_number").alias("in_use"))
    seen = files.join(highest, "file_name", "left").join(in_use, ["file_name", "md5"], "left")
    return seen.select(
        "file_name", "md5", "in_use", "highest",
        F.when(F.col("in_use").isNull(), "new")
        .when(F.col("in_use") == F.col("highest"), "up_to_date")
        .otherwise("older").alias("status"),
    )


def next_versions(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows to append: files with new content get the highest version + 1."""
    return version_status(files, versions).where("status = 'new'").select(
        "file_name", "md5", (F.coalesce("highest", F.lit(0)) + 1).cast("int").alias("version_number")
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("file_name").agg(
        F.max_by("md5", "version_number").alias("md5"), F.max("version_number").alias("version_number")
    )
