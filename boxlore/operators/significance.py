"""Significance of rows, and the boost around moments a customer marked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from boxlore.plans.ordered import sum_around
from boxlore.plans.skew import join_per_key


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that measure something: no ids, scores or thresholds."""
    skip = ("score", "threshold")
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != "id" and not any(s in f.name.lower() for s in skip)
    ]


def _scaled(name: str) -> Column:
    low, high, value = F.col(f"_min_{name}"), F.col(f"_max_{name}"), F.col(name).cast("double")
    return F.when(value.isNull(), F.lit(None)).when(low == high, F.lit(0.0)).otherwise((value - low) / (high - low))


def significance(df: DataFrame, columns: list[str] | None = None, keys: list[str] = ["rxid"]) -> DataFrame:
    """Mean of the min-max scaled numeric columns per receiver (``significance_score``).

    NULLs do not count, constant columns give 0, rows with no number get NULL.
    The ranges are a map-side aggregate, joined back without gathering a busy receiver."""
    columns = columns or numeric_features(df)
    ranges = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[
        f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))
    ])
    scaled = [_scaled(c) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scaled])
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    joined = join_per_key(df, ranges, keys, "_rows").withColumn(
        "significance_score", F.when(filled > 0, total / filled)
    )
    return joined.select(*[c for c in df.columns if c != "significance_score"], "significance_score")


def boost_marked(df: DataFrame, minutes: int = 1, boost: float = 5.0, keys: list[str] = ["rxid"]) -> DataFrame:
    """Every marked row adds ``boost`` to all rows of its receiver within +-``minutes``."""
    if "significance_score" not in df.columns:
        df = df.withColumn("significance_score", F.lit(None).cast("double"))
    if "important_investigate" not in df.columns:
        df = df.withColumn("important_investigate", F.lit(None).cast("boolean"))
    marked = (F.col("customer_marked_flag") == "YES") & F.col("timestamp").isNotNull()
    near = sum_around(df, keys, "timestamp", F.when(marked, 1).otherwise(0), minutes * 60, "_marks")
    hit = F.col("_marks") > 0
    return near.withColumns({
        "significance_score": F.when(
            hit, F.coalesce("significance_score", F.lit(0.0)) + F.col("_marks") * F.lit(float(boost))
        ).otherwise(F.col("significance_score")),
        "important_investigate": F.when(hit, F.lit(True)).otherwise(F.col("important_investigate")),
    }).drop("_marks")
