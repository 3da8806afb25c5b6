"""Parsed rows to stored rows: fill-ins, provenance, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxlore.functions.text import file_name, log_base_name, receivers_of_name
from boxlore.plans.groups import first_per_key
from boxlore.sources.tables import add_missing

ORDER = ["directory_file", "line_no"]


def fill_in(df: DataFrame, file: Column | None = None) -> DataFrame:
    """Defaults of the store: file name, message text, message hash, event type."""
    df = add_missing(df, ["directory_file", "message", "data", "event_type"])
    if file is not None:
        df = df.withColumn("directory_file", F.coalesce("directory_file", file))
    return df.withColumns({
        "message": F.coalesce("message", F.lit("N/A")),
        "data_hash": F.md5(F.coalesce(F.col("data"), F.lit(""))),
    })


def with_provenance(df: DataFrame, source_table: Column) -> DataFrame:
    """Receiver ids taken from the source table name; rows without one are left out."""
    first, second = receivers_of_name(source_table)
    return df.withColumns({"rxid": first, "rxid2": second, "source_table": source_table}).where("rxid IS NOT NULL")


def source_table(rxid: Column, path: Column) -> Column:
    return F.concat_ws("_", rxid, log_base_name(file_name(path)))


def dedupe_keys(how: str) -> list[str]:
    return {"data": ["rxid", "data_hash"], "data_ts": ["rxid", "data_hash", "timestamp"]}[how]


def dedupe(df: DataFrame, stored: DataFrame | None = None, how: str = "data", order: list[str] | None = None) -> DataFrame:
    """First row per receiver and message hash (``data``), or per hash and time
    (``data_ts``), that is not stored yet."""
    keys = dedupe_keys(how)
    kept = first_per_key(df, keys, order or ORDER)
    return kept if stored is None else kept.join(stored.select(*keys), keys, "left_anti")


def duplicate_counts(df: DataFrame, kept: DataFrame, by: str = "directory_file") -> DataFrame:
    """Rows tried, stored and dropped per file."""
    tried = df.groupBy(by).agg(F.count("*").alias("attempted"))
    stored = kept.groupBy(by).agg(F.count("*").alias("inserted"))
    inserted = F.coalesce("inserted", F.lit(0))
    dropped = F.col("attempted") - inserted
    return tried.join(stored, by, "left").select(
        by, "attempted", inserted.alias("inserted"), dropped.alias("duplicates"),
        (dropped / F.col("attempted") * 100).alias("duplicate_pct"),
    )
