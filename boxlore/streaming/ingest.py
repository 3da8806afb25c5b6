"""Continuous ingest: new files are parsed once, whatever restarts happen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from boxlore import jobs
from boxlore.sources.files import of_text


def file_stream(spark: SparkSession, root: str, files_per_batch: int = 10_000) -> DataFrame:
    """Text rows of files as they arrive, by blocks like those of the batch reader."""
    raw = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return of_text(raw.load(root))


def start_ingest(spark: SparkSession, root: str, store: str, checkpoint: str, reference_year: int,
                 dataset: str = "main", interval: str | None = None) -> StreamingQuery:
    """Each batch adds to the log table, then to the import registry.

    A batch that is repeated after a crash replaces its rows, or finds its files in the
    registry, so nothing is stored twice."""

    def load(batch: DataFrame, batch_id: int) -> None:
        jobs.store_lines(batch, store, reference_year, dataset)

    writer = file_stream(spark, root).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
