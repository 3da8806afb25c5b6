"""Bringing per-key values back to rows when one key may own a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Any other key then holds at most 1/10,000 of all rows.
BUSY_KEYS = 10_000


def join_per_key(df: DataFrame, per_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Left join of one row per key; ``count`` is the number of rows of ``df`` per key.

    The values of the 10,000 keys with most rows are broadcast.  The others are
    joined by shuffle, where rows of busy keys travel under made-up keys that
    spread them evenly.  The result is not partitioned by ``keys``, so no later
    window inherits a partition full of one key."""
    columns = [c for c in per_key.columns if c not in keys and c != count]
    values = per_key.select(*keys, count, F.struct(*columns).alias("_values"))
    busy = values.orderBy(F.desc(count)).limit(BUSY_KEYS).drop(count).withColumnRenamed("_values", "_busy")
    rows = df.join(F.broadcast(busy), keys, "left")
    # other rows have salt 0; rows of busy keys get a salt that no value has
    salt = F.when(F.col("_busy").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(df)]), F.lit(1_000_003)) + 1
    )
    rows = rows.withColumn("_salt", salt)
    rest = values.drop(count).withColumnRenamed("_values", "_rest").withColumn("_salt", F.lit(0).cast("bigint"))
    joined = rows.join(rest, [*keys, "_salt"], "left").withColumn("_values", F.coalesce("_busy", "_rest"))
    names = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return joined.select(*names, *[F.col(f"_values.{c}").alias(c) for c in columns])


def _hashable(df: DataFrame) -> list[str]:
    """Columns that tell rows of one key apart without reading wide ones."""
    plain = [c for c, t in df.dtypes if t in ("bigint", "int", "timestamp", "timestamp_ntz", "double")]
    return plain or [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
