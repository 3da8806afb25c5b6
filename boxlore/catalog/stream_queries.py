"""Streams over the event table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxlore.catalog import views
from boxlore.catalog.registry import query
from boxlore.session import checkpoint_dir
from boxlore.sources.tables import read_latest
from boxlore.streaming import counts, sessions


def _log_stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The log view as a stream, and a fresh folder for its tables."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return views.log_columns(raw), f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


@query("stream_row_counts", "SELECT rxid AS table_name, count(*) AS row_count FROM logs GROUP BY rxid ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    rows, folder = _log_stream(spark, sf)
    counts.start_counts(rows, f"{folder}/counts", f"{folder}/checkpoint", None).awaitTermination()
    return counts.read_largest(spark, f"{folder}/counts", 20)


@query("stream_sessions", """
WITH s AS (SELECT *, sum(CASE WHEN kind = 18 THEN 1 ELSE 0 END) OVER (
  PARTITION BY rxid ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM logs),
 n AS (SELECT *, max(session_no) OVER (PARTITION BY rxid) AS newest FROM s)
SELECT rxid, session_no, count(*) FILTER (kind = 22) AS "BlackScreen", count(*) FILTER (kind IN (23, 25)) AS n_other_events
FROM n WHERE session_no < newest GROUP BY rxid, session_no""")
def _(spark, sf):
    """Finished sessions; the newest one of each receiver stays open."""
    rows, folder = _log_stream(spark, sf)
    sessions.start_sessions(rows, f"{folder}/out", f"{folder}/checkpoint", slice_seconds=86400, groups=1).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("rxid", "session_no", "BlackScreen", "n_other_events")


_BATCHES, _DAYS, _TIMEOUT = 5, 6, 40_000
_FILE_ROWS = 100_000  # rows of a file of the input
_START = 1704067200  # 2024-01-01 in seconds


def _in_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The log view as a stream of several batches, by days; every 40th row arrives a batch late.

    Each receiver is split in twenty, so that some send nothing for a while."""
    folder = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    days = F.floor((F.unix_seconds("timestamp") - _START) / (_DAYS * 86400)) + F.when(F.col("id") % 40 == 7, 1).otherwise(0)
    rows = views.logs(spark, sf).withColumns({
        "batch": F.least(F.lit(_BATCHES - 1), days), "rxid": F.concat("rxid", F.lit("-"), (F.col("id") % 20).cast("string"))})
    largest = rows.where(F.col("batch") >= 0).groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    files, schema = max(1, -(-largest // _FILE_ROWS)), rows.drop("batch").schema
    for batch in range(_BATCHES):
        rows.where(F.col("batch") == batch).drop("batch").repartition(files).write.mode("append").parquet(f"{folder}/in")
        # each batch has as many files as a trigger takes: a task without rows may have written none
        for _ in range(files * (batch + 1) - len(spark.read.schema(schema).parquet(f"{folder}/in").inputFiles())):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder


@query("stream_sessions_in_batches", f"""
WITH b AS (
  SELECT rxid || '-' || CAST(id % 20 AS VARCHAR) AS rxid, id, "timestamp", kind, least({_BATCHES - 1},
    (epoch_us("timestamp") // 1000000 - {_START}) // ({_DAYS} * 86400) + CASE WHEN id % 40 = 7 THEN 1 ELSE 0 END) AS batch FROM logs),
 -- the time the stream has reached when a batch is handled: the latest stamp of the batches before it
 reached AS (SELECT batch + 1 AS batch, max(max("timestamp")) OVER (ORDER BY batch) AS seen FROM b GROUP BY batch),
 s AS (
  SELECT *, sum(CASE WHEN kind = 18 THEN 1 ELSE 0 END) OVER (PARTITION BY rxid ORDER BY batch, "timestamp", id ROWS UNBOUNDED PRECEDING) AS marked,
    row_number() OVER (PARTITION BY rxid, batch ORDER BY "timestamp", id) AS place FROM b),
 -- the session open after each batch of a receiver, its last stamp, and the receiver's next batch
 o AS (
  SELECT rxid, batch, lead(batch, 1, {_BATCHES + 1}) OVER w AS next, lead(starts) OVER w AS next_starts, (
    SELECT max("timestamp") FROM s WHERE s.rxid = v.rxid AND s.batch <= v.batch AND s.marked = v.marked) AS last
  FROM (SELECT rxid, batch, max(marked) AS marked, bool_or(place = 1 AND kind = 18) AS starts FROM s GROUP BY rxid, batch) v
  WINDOW w AS (PARTITION BY rxid ORDER BY batch)),
 cut AS (SELECT o.*, coalesce(seen >= last + INTERVAL {_TIMEOUT} SECOND, false) AS cut FROM o LEFT JOIN reached r ON r.batch = o.next - 1),
 -- rows after a cut that do not begin with a marker begin a session all the same
 more AS (SELECT rxid, next AS batch, sum(CASE WHEN cut AND NOT next_starts THEN 1 ELSE 0 END) OVER (PARTITION BY rxid ORDER BY batch) AS more FROM cut),
 n AS (SELECT s.*, CAST(marked + coalesce(more, 0) AS BIGINT) AS session_no FROM s LEFT JOIN more USING (rxid, batch)),
 t AS (
  SELECT rxid, session_no, max(batch) AS batch, count(*) FILTER (kind = 22) AS "BlackScreen", count(*) FILTER (kind IN (23, 25)) AS n_other_events,
    CAST(epoch_us(max("timestamp")) AS BIGINT) AS last_us, max(session_no) OVER (PARTITION BY rxid) AS newest FROM n GROUP BY rxid, session_no),
 e AS (
  SELECT t.*, CASE WHEN cut.cut AND lead(t.batch, 1, 99) OVER (PARTITION BY t.rxid ORDER BY session_no) > t.batch THEN 'timeout'
    WHEN session_no < newest THEN 'marker' END AS ended
  FROM t JOIN cut ON cut.rxid = t.rxid AND cut.batch = t.batch)
SELECT rxid, session_no, ended, "BlackScreen", n_other_events, last_us FROM e WHERE ended IS NOT NULL""")
def _(spark, sf):
    """Five batches with late rows and a timeout: sessions ended by a marker or by the timer."""
    rows, folder = _in_batches(spark, sf)
    sessions.start_sessions(rows, f"{folder}/out", f"{folder}/checkpoint", _TIMEOUT, slice_seconds=86400, groups=1).awaitTermination()
    ended = spark.read.parquet(f"{folder}/out")
    return ended.select("rxid", "session_no", "ended", "BlackScreen", "n_other_events", F.unix_micros("last_timestamp").alias("last_us"))


@query("stream_embedding_input", "SELECT id, CAST(length(data) AS INTEGER) AS n FROM logs")
def _(spark, sf):
    rows, folder = _log_stream(spark, sf)
    embed = lambda batch: batch.select("id", F.length("data").alias("n"))
    counts.start_embedding(rows, embed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "n")
