"""Running row counts, and embeddings of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from boxlore.operators.report import largest, row_counts
from boxlore.sources.tables import read_latest, write_next


def running_counts(rows: DataFrame) -> DataFrame:
    """Row count per receiver over a stream; write in complete or update mode.
    Counts fold map-side, and the state is one number per receiver."""
    return row_counts(rows)


def start_counts(rows: DataFrame, table: str, checkpoint: str, interval: str | None = "30 seconds") -> StreamingQuery:
    """Keep ``table`` (a versioned folder) at the latest counts of all receivers; ``read_largest`` reads the top."""

    def publish(counts: DataFrame, batch_id: int) -> None:
        write_next(counts, table)

    writer = running_counts(rows).writeStream.outputMode("complete").foreachBatch(publish)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_largest(spark: SparkSession, table: str, n: int = 20) -> DataFrame:
    """The ``n`` largest receivers by the latest complete counts."""
    return largest(read_latest(spark, table), n)


def start_embedding(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                    interval: str | None = None) -> StreamingQuery:
    """Embed rows as they arrive; the checkpoint is the high-water mark."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch, so that a repeated batch replaces itself
        embed(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
