"""Report tables over logs and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxlore.plans.median import exact_median


def row_counts(df: DataFrame, by: str = "rxid", run_time: Column | None = None) -> DataFrame:
    counts = df.groupBy(F.col(by).alias("table_name")).agg(F.count("*").alias("row_count"))
    return counts if run_time is None else counts.withColumn("last_updated", run_time)


def largest(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("row_count"), "table_name").limit(n)


def newest_and_count(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.max("timestamp").alias("max_ts"), F.count("*").alias("n"))


def daily_counts(df: DataFrame) -> DataFrame:
    """Rows per day and receiver, one row per filled cell (any number of receivers)."""
    return df.groupBy(F.to_date("timestamp").alias("day"), "rxid").agg(F.count("significance_score").alias("n"))


def daily_pivot(df: DataFrame, receivers: list[str]) -> DataFrame:
    """The same as a table with one column per listed receiver, empty cells 0."""
    counts = df.where(F.col("rxid").isin(receivers)).groupBy(F.to_date("timestamp").alias("day"))
    return counts.pivot("rxid", receivers).agg(F.count("significance_score")).na.fill(0)


def impute_median(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Missing stamps become the median of the others."""
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    middle = exact_median(df, micros)
    return df.withColumn(
        column, F.coalesce(F.col(column).cast("timestamp"), F.timestamp_micros(F.floor(middle.scalar()).cast("bigint")))
    )


def colour() -> Column:
    """Chart colour of an anomaly: the first rule that holds."""
    text = F.lower(F.concat_ws("\n", "message", "event_type"))
    recon = F.coalesce("recon_is_anomaly", F.lit(False))
    seq = F.coalesce("seq_is_anomaly", F.lit(False))
    return (
        F.when(text.contains("epg handle"), "green")
        .when(text.rlike("signal[ _]protector"), "yellow")
        .when(recon & seq, "black")
        .when(recon, "red")
        .when(seq, "orange")
        .otherwise("blue")
    )


def marker_sizes(df: DataFrame, column: str = "sgs_duration_ms", name: str = "size") -> DataFrame:
    """Dot sizes 5..30 relative to the largest value; missing values count as 1."""
    value = F.coalesce(F.col(column).cast("string").try_cast("double"), F.lit(1.0))
    top = df.agg(F.max(value).alias("m")).scalar()
    scaled = F.greatest(F.lit(5.0), F.least(F.lit(30.0), value / top * 20))
    return df.withColumn(name, F.when(top > 0, scaled).otherwise(F.lit(5.0)))


def correlation_view(anomalies: DataFrame) -> DataFrame:
    """Anomalies with the fields of the time/receiver/significance chart."""
    return anomalies.select(
        "timestamp", "rxid", F.coalesce("significance_score", F.lit(0.0)).alias("significance_score"),
        "recon_is_anomaly", "seq_is_anomaly", "sgs_duration_ms", "event_type", "message",
    )
