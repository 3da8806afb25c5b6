"""Anomalies of all receivers in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from boxlore.sources.tables import stack

FLAGS = ("customer_marked_flag", "important_investigate")


def anomaly_predicate(df: DataFrame, extra: list[Column] | None = None) -> Column:
    """What counts as an anomaly, read from the columns a table has.

    ``*_is_anomaly`` true, ``*score*`` above 0, or one of the two flags set."""
    tests: list[Column] = list(extra or [])
    for field in df.schema.fields:
        name, column = field.name.lower(), F.col(f"`{field.name}`")
        if name.endswith("is_anomaly"):
            tests.append(column.try_cast("boolean"))
        elif "score" in name and isinstance(field.dataType, (T.NumericType, T.StringType)):
            tests.append(column.try_cast("double") > 0)
        elif name in FLAGS:
            tests.append(column.try_cast("boolean"))
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def gather(df: DataFrame, name: Column | None = None, extra: list[Column] | None = None) -> DataFrame:
    """Anomalous rows of a log table with the receiver as ``table_name``."""
    return df.where(anomaly_predicate(df, extra)).withColumn("table_name", F.col("rxid") if name is None else name)


def gather_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """The same over tables with different columns, each judged by its own columns."""
    return stack([gather(df, F.lit(name)) for name, df in tables.items()])


def anomaly_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("rxid").agg(F.count_if(anomaly_predicate(df)).alias("anomalies"))
