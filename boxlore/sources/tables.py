"""Reading and writing engine tables: ranges, schema growth, upserts, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxlore.functions.text import is_receiver


def receivers(df: DataFrame, column: str = "rxid") -> DataFrame:
    """Distinct receiver ids of a log table."""
    return df.where(is_receiver(F.col(column))).select(column).distinct()


def between(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """Rows in ``[start, end]``; a bound left out does not filter.  The comparison
    is on the bare column, so it reaches the parquet scan."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def of_receivers(df: DataFrame, ids: list[str], column: str = "rxid") -> DataFrame:
    return df.where(F.col(column).isin(ids))


def has_columns(df: DataFrame, needed: list[str]) -> bool:
    present = {c.lower() for c in df.columns}
    return all(c.lower() in present for c in needed)


def new_column_type(name: str) -> str:
    return "bigint" if name.endswith("_num") else "string"


def add_missing(df: DataFrame, needed: list[str]) -> DataFrame:
    """Needed columns that are absent come in as NULLs of their default type."""
    present = {c.lower() for c in df.columns}
    missing = [c for c in needed if c.lower() not in present]
    return df.withColumns({c: F.lit(None).cast(new_column_type(c)) for c in missing}) if missing else df


def spell_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rename columns that differ from a needed name only in case, then add missing ones."""
    present = {c.lower(): c for c in df.columns}
    renames = {present[c.lower()]: c for c in needed if present.get(c.lower(), c) != c}
    return add_missing(df.withColumnsRenamed(renames) if renames else df, needed)


def migrate_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Move ``old`` into ``new`` (kept where already filled) and drop ``old``."""
    if old.lower() == new.lower() or old not in df.columns:
        return df
    moved = F.col(old) if new not in df.columns else F.coalesce(F.col(new), F.col(old))
    return df.withColumn(new, moved).drop(old)


def stack(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns, aligned by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


# --- versioned folders: a table is replaced by writing its next version ------------


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(name[2:]))
    return sorted(done)


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest completed version of a table, None before the first."""
    done = _versions(spark, root)
    return spark.read.parquet(f"{root}/v={done[-1]}") if done else None


def write_next(df: DataFrame, root: str) -> str:
    """Write the next version; readers keep the previous one until this completes."""
    done = _versions(df.sparkSession, root)
    path = f"{root}/v={(done[-1] if done else 0) + 1}"
    df.write.mode("overwrite").parquet(path)
    return path


def upsert_table(new: DataFrame, root: str, keys: list[str]) -> str:
    old = read_latest(new.sparkSession, root)
    return write_next(new if old is None else upsert(old, new, keys), root)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to all cores when the files gave too few splits with rows (gzip, few
    row groups, however many splits they are cut into); otherwise the scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    # reads no column: the counts are in the footers
    filled = df.rdd.getNumPartitions() >= cores and df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if filled < cores else df


#: groups of receivers, each with a folder a day
GROUPS = 64


def receiver_group(rxid: Column, groups: int = GROUPS) -> Column:
    return F.pmod(F.xxhash64(rxid), F.lit(groups)).cast("int")


def write_logs(df: DataFrame, path: str, mode: str = "append", groups: int = GROUPS) -> None:
    """The wide log table, in folders of day and receiver group.

    One folder per receiver would mean millions of folders.  Rebalancing splits
    a group that one busy receiver fills and joins small ones; sorting lets the
    parquet statistics skip to a receiver.
    """
    (
        df.withColumn("day", F.to_date("timestamp"))
        .withColumn("receiver_group", receiver_group(F.col("rxid"), groups))
        .hint("rebalance", "day", "receiver_group")
        .sortWithinPartitions("day", "receiver_group", "rxid", "timestamp")
        .write.mode(mode)
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy("day", "receiver_group")
        .parquet(path)
    )


def read_logs(spark: SparkSession, path: str, rxid: str | None = None, start=None, end=None, groups: int = GROUPS,
              further: dict[str, str] | None = None) -> DataFrame:
    """Log table, pruned to the folders of a receiver and of the days asked for.

    ``further`` names columns, with their types, that only some of the files have."""
    df = spark.read.parquet(path)
    missing = {c: kind for c, kind in (further or {}).items() if c.lower() not in {x.lower() for x in df.columns}}
    if missing:
        for column, kind in missing.items():
            df = df.withColumn(column, F.lit(None).cast(kind))
        df = spark.read.schema(df.schema).parquet(path)
    if rxid is not None:
        df = df.where((F.col("receiver_group") == receiver_group(F.lit(rxid), groups)) & (F.col("rxid") == rxid))
    if start is not None:
        df = df.where(F.col("day") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col("day") <= F.to_date(F.lit(end)))
    return between(df, start, end)
