"""Files to stored rows: reading text of any size, and asking the message index instead of the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boxlore import jobs
from boxlore.catalog.registry import query
from boxlore.catalog.views import lines, logs
from boxlore.functions.text import receiver_of_path
from boxlore.operators import extras, store
from boxlore.session import checkpoint_dir
from boxlore.sources import files, hash_index, tables, text_files

YEAR = 2024


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"


def write_text(rows, text: str, folder: str, end: str = "\n") -> str:
    """One file of lines per receiver (``rxid``), in the order of ``id``."""
    text_files.write_files(rows, "rxid", ["id"], text, folder, end)
    return folder


@query("read_lines_of_files", """
SELECT rxid, CAST(2 * (place - 1) + half AS BIGINT) AS line_no,
  CASE half WHEN 0 THEN data ELSE 'R' || CAST(id AS VARCHAR) END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY rxid ORDER BY id) AS place FROM logs), (SELECT unnest([0, 1]) AS half)""")
def _(spark, sf):
    """Text files, cut at several line ends and read in blocks: numbered lines."""
    rows = logs(spark, sf)
    end = F.when(F.col("id") % 2 == 0, "\u2028").otherwise("\r")
    folder = write_text(rows.withColumn("text", F.concat("data", end, F.lit("R"), F.col("id").cast("string"))), "text", fresh_folder(spark, "files"))
    cut = files.stored_lines(files.cut_lines(files.raw_lines(spark, folder)), fresh_folder(spark, "lines"))
    placed = files.placed_blocks(files.summed_blocks(cut))
    return files.numbered_lines(cut, placed).select(receiver_of_path(F.col("path")).alias("rxid"), "line_no", "line")


@query("hash_files", """
WITH t AS (SELECT u % 40 AS g, string_agg(data, '|' ORDER BY id) AS text, count(*) AS n FROM logs GROUP BY u % 40)
SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS lines, count(DISTINCT text) AS contents FROM (SELECT * FROM t UNION ALL SELECT * FROM t)""")
def _(spark, sf):
    """Each file twice, with other line ends and so other blocks: as many hashes as there are contents."""
    rows = logs(spark, sf).withColumn("rxid", F.concat(F.lit("g"), (F.col("u") % 40).cast("string")))
    folder = fresh_folder(spark, "files")
    write_text(rows, "data", f"{folder}/a")
    write_text(rows, "data", f"{folder}/b", "\r\n")
    cut = files.cut_lines(files.raw_lines(spark, folder))
    found = files.files_of(files.placed_blocks(files.summed_blocks(cut)))
    return found.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.count_distinct("file_hash").alias("contents"))


@query("ingest_files", """
SELECT rxid, line_no, us, pattern FROM (
  SELECT 'R' || lpad(u, 10, '0') AS rxid, CAST(row_number() OVER (PARTITION BY path ORDER BY event_id) - 1 AS BIGINT) AS line_no,
    epoch_us(ts_out) AS us, CASE f WHEN 0 THEN 'standard_log' WHEN 1 THEN 'qt_ui' WHEN 2 THEN 'qt_ui_chunks' WHEN 3 THEN 'invidi_debug'
      WHEN 4 THEN 'wjap_logs' WHEN 5 THEN 'sbsdk_logs' WHEN 6 THEN 'timestamp_colon_ms' WHEN 7 THEN 'pipeline_control'
      ELSE 'generic' END AS pattern,
    row_number() OVER (PARTITION BY path, CASE f WHEN 7 THEN u || k ELSE f || '-' || k END ORDER BY event_id) AS again
  FROM lines) WHERE us IS NOT NULL AND again = 1""")
def _(spark, sf):
    """The whole job: text files to rows of the log table."""
    rows = lines(spark, sf).select(receiver_of_path(F.col("path")).alias("rxid"), F.col("line_no").alias("id"), "line")
    folder = fresh_folder(spark, "ingest")
    jobs.ingest(spark, write_text(rows, "line", f"{folder}/in"), f"{folder}/tables", YEAR, groups=2)
    found = spark.read.parquet(f"{folder}/tables/logs")
    return found.select("rxid", "line_no", F.unix_micros("timestamp").alias("us"), "pattern")


@query("store_in_three_batches", """
SELECT id, CAST(batch AS VARCHAR) AS batch FROM (
  SELECT *, row_number() OVER (PARTITION BY rxid, data ORDER BY batch, id) AS place FROM (SELECT *, id % 3 AS batch FROM logs))
WHERE place = 1""")
def _(spark, sf):
    """Three batches, the second of them run twice: the index tells what each one adds."""
    rows = store.fill_in(logs(spark, sf))
    folder = fresh_folder(spark, "batches")
    index = hash_index.open_index(spark, f"{folder}/index", store.dedupe_keys("data"), groups=4, parts=2)
    for number in (0, 1, 1, 2):
        batch = store.dedupe(rows.where(F.col("id") % 3 == number), order=["id"])
        path = f"{folder}/rows/batch={number}"
        index.unseen(batch, str(number)).select("rxid", "data_hash", "id").write.mode("overwrite").parquet(path)
        index.learn(spark.read.parquet(path), str(number))
        if number == 1:
            index.compact(2)
    stored = spark.read.schema("rxid string, data_hash string, id long, batch string").parquet(f"{folder}/rows")
    return stored.select("id", "batch")


_KEYS = {"signal": "CAST(v AS BIGINT)", "Net Mode": "'m' || u", "locked": "v % 2 = 0", "spare_num": "CASE WHEN id % 2 = 0 THEN u END"}


def _with_extras(spark, sf):
    """Details of four unknown keys: a number, a text, a truth value, and a number half of the rows have."""
    pairs = F.create_map(
        F.lit("signal"), F.col("v").cast("string"), F.lit("Net Mode"), F.concat(F.lit("m"), F.col("u").cast("string")),
        F.lit("locked"), (F.col("v") % 2 == 0).cast("string"), F.lit("spare_num"), F.when(F.col("id") % 2 == 0, F.col("u").cast("string")))
    return logs(spark, sf).select("id", "category", extras.packed(pairs).alias("extras"))


@query("unknown_keys", """
SELECT key, CAST(rows AS BIGINT) AS rows, kind FROM (
  SELECT count(*) AS n, count(*) FILTER (id % 2 = 0) AS half FROM logs),
  LATERAL (VALUES ('signal', n, 'BIGINT'), ('Net Mode', n, 'STRING'), ('locked', n, 'BOOLEAN'), ('spare_num', half, 'BIGINT')) AS t(key, rows, kind)""")
def _(spark, sf):
    return extras.key_counts(_with_extras(spark, sf))


@query("stack_growing_extras", f"""
SELECT id, {_KEYS['signal']} AS signal, {_KEYS['Net Mode']} AS net_mode, {_KEYS['locked']} AS locked, {_KEYS['spare_num']} AS spare_num,
  id % 3 > 0 AS promoted FROM logs""")
def _(spark, sf):
    """Three batches; the keys of the first become typed columns of the others, and stored rows answer from extras."""
    rows, folder = _with_extras(spark, sf), fresh_folder(spark, "extras")
    listed = f"{folder}/promoted"
    for number in range(3):
        batch = rows.where(F.col("id") % 3 == number)
        keys = extras.read_promoted(spark, listed)
        extras.promoted(batch, keys).write.parquet(f"{folder}/rows/batch={number}")
        extras.note_promoted(spark, listed, extras.frequent_keys(spark.read.parquet(f"{folder}/rows/batch={number}")))
    keys = extras.read_promoted(spark, listed)
    stored = tables.read_logs(spark, f"{folder}/rows", further={name: kind for _, name, kind in keys})
    return extras.promoted(stored.withColumn("promoted", F.col("signal").isNotNull()), keys).select(
        "id", *[name for _, name, _ in keys], "promoted")
