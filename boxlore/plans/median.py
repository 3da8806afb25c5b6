"""Exact median without sorting or holding the values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def exact_median(df: DataFrame, value: Column, widths: tuple[int, ...] = (3_600_000_000, 1_000_000, 1)) -> DataFrame:
    """One row ``median`` (double) over a whole-number column.

    Counts per bin find the bin of the middle rank; the next pass looks only
    inside it with narrower bins.  Each pass is one partial-aggregated count; the
    running sum sees one row per bin (hours of the data, seconds of an hour, ...).
    """
    rows = df.select(value.cast("bigint").alias("v")).where(F.col("v").isNotNull())
    total = rows.agg(F.count("*").alias("n"))
    low_rank = F.floor((total.scalar() + 1) / 2)
    high_rank = F.floor(total.scalar() / 2) + 1
    found: DataFrame | None = None
    for width in widths:
        part, before = rows, F.lit(0)
        if found is not None:
            part = rows.where((F.col("v") >= found.scalar()["low"]) & (F.col("v") <= found.scalar()["high"]))
            before = found.scalar()["before"]
        bins = part.groupBy((F.col("v") - F.pmod("v", F.lit(width))).alias("bin")).agg(F.count("*").alias("n"))
        upto = bins.select("bin", "n", (before + F.sum("n").over(W.orderBy("bin"))).alias("upto"))
        found = upto.agg(
            F.struct(
                F.min(F.when(F.col("upto") >= low_rank, F.col("bin"))).alias("low"),
                (F.min(F.when(F.col("upto") >= high_rank, F.col("bin"))) + (width - 1)).alias("high"),
                F.min(F.when(F.col("upto") >= low_rank, F.col("upto") - F.col("n"))).alias("before"),
            ).alias("at")
        )
    return found.select(((F.col("at.low") + F.col("at.high")) / 2).alias("median"))
