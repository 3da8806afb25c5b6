"""Log graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxlore.plans.groups import first_per_key


def _category() -> Column:
    return F.coalesce(F.nullif("category", F.lit("")), F.lit("UNKNOWN"))


def line_key() -> Column:
    stamp = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    return F.concat_ws("_", stamp, _category(), F.md5(F.coalesce("data", F.lit(""))))


def line_nodes(df: DataFrame, order: list[str] = ["directory_file", "line_no"]) -> DataFrame:
    """LogLine nodes; of equal keys the first line sets the properties."""
    rows = df.select(line_key().alias("id"), "timestamp", "data", "event_type", *order)
    return first_per_key(rows, ["id"], order).select("id", "timestamp", "data", "event_type")


def edges(df: DataFrame) -> DataFrame:
    """(src, dst, rel), each once.  All three kinds come from one pass over the rows."""
    key = line_key()
    edge = lambda src, dst, rel: F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))
    kinds = F.array(
        edge(_category(), key, "GENERATED"),
        F.when(F.col("sid").isNotNull(), edge(key, F.col("sid"), "PART_OF_SESSION")),
        F.when(F.col("cid").isNotNull(), edge(key, F.col("cid"), "ASSOCIATED_WITH")),
    )
    return df.select(F.explode(F.array_compact(kinds)).alias("e")).select("e.*").distinct()


def named_nodes(df: DataFrame) -> DataFrame:
    """(id, label) of processes, sessions and connections, each once."""
    node = lambda value, label: F.struct(value.alias("id"), F.lit(label).alias("label"))
    kinds = F.array(
        node(_category(), "Process"),
        F.when(F.col("sid").isNotNull(), node(F.col("sid"), "Session")),
        F.when(F.col("cid").isNotNull(), node(F.col("cid"), "Connection")),
    )
    return df.select(F.explode(F.array_compact(kinds)).alias("n")).select("n.*").distinct()


def nodes(df: DataFrame) -> DataFrame:
    """All nodes as (id, label, props)."""
    stamp = F.coalesce(F.col("timestamp").cast("string"), F.lit(""))
    pairs = [F.lit("timestamp"), stamp, F.lit("data"), F.col("data"), F.lit("event_type"), F.col("event_type")]
    lines = line_nodes(df).select("id", F.lit("LogLine").alias("label"), F.create_map(*pairs).alias("props"))
    return lines.unionByName(named_nodes(df).withColumn("props", F.create_map().cast("map<string,string>")))


def write_graph(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    nodes(df).write.mode(mode).partitionBy("label").parquet(f"{path}/nodes")
    edges(df).write.mode(mode).partitionBy("rel").parquet(f"{path}/edges")
