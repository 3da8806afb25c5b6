"""First row and first n rows per group, reduced before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key.  A min aggregate folds copies map-side, so a
    message repeated a billion times reaches the shuffle once per task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*[F.col(f"`{c}`") for c in df.columns])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: int = 64) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (which must be total).

    Groups are first cut into ``spread`` parts by row hash and each part keeps
    its own first ``n``; at most ``spread * n`` rows of a group meet in one task.
    """
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(spread)))
    inner = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    outer = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    kept = salted.withColumn("_n", inner).where(F.col("_n") <= n).drop("_n", "_part")
    return kept.withColumn("_n", outer).where(F.col("_n") <= n).drop("_n")


def dense_codes(df: DataFrame, column: str, code: str = "code", prefix: int = 8) -> DataFrame:
    """0-based rank of each distinct value in sorted order.

    Values are ranked inside their leading characters, and only one row per
    distinct prefix goes through the global running sum.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(
        "_prefix", F.substring(F.col(column), 1, prefix)
    )
    sizes = values.groupBy("_prefix").agg(F.count("*").alias("_n"))
    starts = sizes.select(
        "_prefix",
        F.coalesce(F.sum("_n").over(W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    ranked = values.withColumn("_n", F.row_number().over(W.partitionBy("_prefix").orderBy(column)))
    return ranked.join(starts, "_prefix").select(column, (F.col("_start") + F.col("_n") - 1).alias(code))
