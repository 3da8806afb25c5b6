"""Options for tables kept in a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_options(url: str, table: str, partition_column: str | None = None, lower=None, upper=None,
                 partitions: int = 32, fetch_size: int = 10_000, **extra: str) -> dict[str, str]:
    """Reader options; with a partition column the table is read in parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(**options)).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 1_000, **extra: str) -> None:
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_size), **extra)
        .mode(mode)
        .save()
    )
