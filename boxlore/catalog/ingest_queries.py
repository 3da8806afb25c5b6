"""Files, lines, parsing, names, de-duplication, registries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from boxlore.catalog.registry import query, table
from boxlore.catalog.views import lines, logs
from boxlore.functions import text
from boxlore.functions.message_fields import epg_event
from boxlore.functions.timestamps import to_utc
from boxlore.operators import parse, store
from boxlore.plans.groups import top_per_group
from boxlore.sources import files, registry, tables

YEAR = 2024


def _parse(rule: str, number: int, columns: dict[str, str]) -> None:
    sql = ", ".join(f"{v} AS {c}" for c, v in columns.items())

    @query(f"parse_{rule}", f"""
    SELECT event_id AS line_no, epoch_us(ts_out) AS us, broken AS timestamp_imputed, {sql} FROM lines
    WHERE f = {number} AND ts_out IS NOT NULL""")
    def _(spark, sf):
        df = parse.parse_lines(lines(spark, sf), YEAR).where(F.col("pattern") == rule)
        return df.select("line_no", F.unix_micros("timestamp").alias("us"), "timestamp_imputed", *columns)


_parse("standard_log", 0, {"category": "event_type", "file_line": "'src.c:' || u", "function": "'run()'", "data": "'val ' || k"})
_parse("qt_ui", 1, {"category": "event_type", "info": "'screen ' || u", "data": "'shown ' || k"})
_parse("qt_ui_chunks", 2, {"category": "event_type", "data": "'part ' || k"})
_parse("invidi_debug", 3, {"component": "'DCore' || u", "data": "'started ' || k"})
_parse("wjap_logs", 4, {"service": "'svc' || u", "pid": "k", "data": "'up ' || k"})
_parse("sbsdk_logs", 5, {"error_level": "'ERR'", "code": "u", "module": "'net'", "function": "'dial'", "data": "'no route ' || k"})
_parse("timestamp_colon_ms", 6, {"data": "strftime(ts, '%m/%d/%Y %H:%M:%S:%g') || ' raw ' || k"})
_parse("generic", 8, {"data": "'plain ' || k"})


@query("parse_control_lines", """
SELECT event_id AS line_no, epoch_us(ts_out) AS us, event_type AS category, '-0700' AS timezone_offset, k AS pid,
  'sub' AS sub_category, '<p.cpp:' || u || '>' AS file_line, 'go' AS function, u AS detail_a, k AS detail_b
FROM lines WHERE f = 7""")
def _(spark, sf):
    df = parse.parse_lines(lines(spark, sf), YEAR).where("pattern = 'pipeline_control'")
    return df.select(
        "line_no", F.unix_micros("timestamp").alias("us"), "category", "timezone_offset", "pid", "sub_category",
        "file_line", "function", F.col("details")["a"].alias("detail_a"), F.col("details")["b"].alias("detail_b"))


@query("parse_all_lines", """
SELECT 'R' || lpad(u, 10, '0') AS rxid, event_id AS line_no, epoch_us(ts_out) AS us,
  CASE f WHEN 0 THEN 'standard_log' WHEN 1 THEN 'qt_ui' WHEN 2 THEN 'qt_ui_chunks' WHEN 3 THEN 'invidi_debug'
    WHEN 4 THEN 'wjap_logs' WHEN 5 THEN 'sbsdk_logs' WHEN 6 THEN 'timestamp_colon_ms' WHEN 7 THEN 'pipeline_control'
    ELSE 'generic' END AS pattern FROM lines WHERE ts_out IS NOT NULL""")
def _(spark, sf):
    df = parse.parse_lines(lines(spark, sf), YEAR)
    return df.select(text.receiver_of_path(F.col("path")).alias("rxid"), "line_no", F.unix_micros("timestamp").alias("us"), "pattern")


@query("parse_lines_in_segments", """
SELECT event_id AS line_no, epoch_us(ts_out) AS us, broken AS timestamp_imputed FROM lines WHERE ts_out IS NOT NULL""")
def _(spark, sf):
    """The large-file form: stamps are carried across block borders."""
    df = lines(spark, sf).withColumn("_segment", F.floor(F.col("line_no") / 1000))
    out = parse.parse_lines(df, YEAR)
    return out.select("line_no", F.unix_micros("timestamp").alias("us"), "timestamp_imputed")


_STAMPS = [
    ("MM/dd/yyyy HH:mm:ss.SSS", 1), ("M/d/yyyy H:m:s", 2), ("yyyy/MM/dd HH:mm:ss", 2), ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", 0),
    ("yyyy.MM.dd HH:mm", 3), ("MM/dd HH:mm:ss", 2), ("MM-dd HH:mm:ss.SSS", 1), ("MMM d HH:mm:ss", 2),
    ("MMMM d HH:mm:ss", 2), ("yyyy-MM-dd HH:mm:ss '-0700'", 4), ("yyyy-MM-dd", 5), ("'at' HH:mm:ss", 6),
]


@query("normalise_timestamps", f"""
SELECT event_id AS id, epoch_us(CASE kind WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN date_trunc('second', ts)
  WHEN 3 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('second', ts) + INTERVAL 7 HOUR WHEN 5 THEN date_trunc('day', ts) END) AS us
FROM (SELECT *, list_extract([{', '.join(str(k) for _, k in _STAMPS)}], CAST(event_id % {len(_STAMPS)} + 1 AS INT)) AS kind FROM events)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    stamp = F.when(F.lit(False), "")
    for i, (form, _) in enumerate(_STAMPS):
        stamp = stamp.when(F.col("event_id") % len(_STAMPS) == i, F.date_format("ts", form))
    return e.select(F.col("event_id").alias("id"), F.unix_micros(to_utc(stamp, YEAR)).alias("us"))


@query("event_tag", "SELECT id, CASE WHEN kind = 24 THEN 'epg_handle_issue' END AS tag FROM logs")
def _(spark, sf):
    return logs(spark, sf).select("id", epg_event(F.col("data")).alias("tag"))


@query("route_files", """
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'var' WHEN event_id % 5 = 0 THEN 'trap' ELSE 'lines' END AS format
FROM events""")
def _(spark, sf):
    first = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "' 'yyyy-MM-dd  HH:mm:ss.SSS")).otherwise(F.col("event_type"))
    name = F.when(F.col("event_id") % 5 == 0, F.lit("R1_K_Trap.log")).otherwise(F.lit("nal.log"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), parse.file_format(first, name).alias("format"))


@query("parse_var_lines", """
SELECT event_id AS line_no, epoch_us(date_trunc('millisecond', ts)) AS us, CAST(user_id AS VARCHAR) AS pid, '7' AS tid,
  'c' AS channel, CASE event_id % 4 WHEN 0 THEN 'lock count' WHEN 1 THEN 'ratio' WHEN 2 THEN 'screen size' ELSE 'link reset' END AS key,
  CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) || '.5'
    WHEN 2 THEN '640x' || CAST(user_id AS VARCHAR) ELSE '' END AS value_str,
  CASE event_id % 4 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN user_id + 0.5 END AS value_num FROM events""")
def _(spark, sf):
    u = F.col("user_id").cast("string")
    pair = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("lock count: "), u))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("ratio: "), u, F.lit(".5")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("screen size: 640x"), u))
        .otherwise(F.lit("link reset:"))
    )
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("  "), u, F.lit(" 7 I VAR - c : "), pair)
    df = table(spark, sf, "events").select(F.lit("/v.log").alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))
    out = parse.parse_var(df)
    return out.select("line_no", F.unix_micros("timestamp").alias("us"), "pid", "tid", "channel", "key", "value_str", "value_num")


def _trap_files(spark, sf):
    date = F.date_format("ts", "MM/dd/yyyy HH:mm:ss")
    u = F.col("user_id").cast("string")
    content = F.concat(
        F.lit("intro text\n---- TIME Received ----\n----------------- "), date,
        F.lit(" ---------------\n----- Software: build-"), u, F.lit(".x -- Model: Box "), u,
        F.lit(" ------------------------\nbody\n---- TIME Received ----\nno date here"))
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("/t/"), F.col("event_id").cast("string")).alias("path"), content.alias("content"))


_TRAP_SQL = """
SELECT '/t/' || CAST(event_id AS VARCHAR) AS path, b AS line_no,
  CASE WHEN b = 1 THEN epoch_us(date_trunc('second', ts)) END AS us,
  CASE WHEN b = 1 THEN 'build-' || CAST(user_id AS VARCHAR) || '.x' END AS software,
  CASE WHEN b = 1 THEN 'Box ' || CAST(user_id AS VARCHAR) END AS model
FROM events, (SELECT unnest([0, 1, 2])::BIGINT AS b)"""


def _trap_columns(df):
    return df.select("path", "line_no", F.unix_micros("timestamp").alias("us"), "software", "model")


@query("parse_trap_blocks", _TRAP_SQL)
def _(spark, sf):
    return _trap_columns(parse.parse_trap(parse.trap_blocks(_trap_files(spark, sf))))


@query("parse_trap_blocks_of_lines", _TRAP_SQL)
def _(spark, sf):
    df = files.lines_of_files(_trap_files(spark, sf)).withColumn("_segment", F.floor(F.col("line_no") / 3))
    return _trap_columns(parse.parse_trap(parse.trap_blocks_of_lines(df)))


@query("names_of_files", """
SELECT event_id AS id, 'R' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS rxid,
  CASE WHEN event_id % 2 = 0 THEN 'R' || lpad(CAST(event_id AS VARCHAR), 10, '0') END AS rxid2,
  event_type || '_log' AS base, 'UNKNOWN_RXID' AS none FROM events""")
def _(spark, sf):
    pad = lambda c: F.concat(F.lit("R"), F.lpad(F.col(c).cast("string"), 10, "0"))
    name = F.concat_ws("_", pad("user_id"), F.when(F.col("event_id") % 2 == 0, pad("event_id")), F.lit("x"))
    file = F.concat(F.col("event_type"), F.lit("--log 2024-01-05 05:11:30."), F.col("event_id").cast("string"))
    first, second = text.receivers_of_name(name)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), first.alias("rxid"), second.alias("rxid2"),
        text.log_base_name(file).alias("base"), text.receiver_of_path(F.col("event_type")).alias("none"))


@query("schema_and_table_names", """
SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 's' ELSE 'public' END AS schema_name,
  CASE event_id % 3 WHEN 1 THEN 'a.' || event_type ELSE event_type END AS table_name FROM events""")
def _(spark, sf):
    t, n = F.col("event_type"), F.col("event_id") % 3
    name = (
        F.when(n == 0, F.concat(F.lit(' "'), t, F.lit('"')))
        .when(n == 1, F.concat(F.lit('"s"."a.'), t, F.lit('"')))
        .otherwise(F.concat(F.lit('.'), t))
    )
    schema, tab = text.schema_and_table(name)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), schema.alias("schema_name"), tab.alias("table_name"))


_TOPIC_CASE = {
    "nal": ("[a]<b><c> fn: {k}", "'a'", "'<b><c> fn: ' || k"), "netra": ("[a]<b><c> fn: {k} ", "'a'", "'fn: ' || k"),
    "stbCtrl": ("[a]<b><c>fn {k}", "'a'", "'fn ' || k"), "wjap": ("Jan 1 svc[12]: up {k}", "NULL", "'up ' || k"),
    "SBSDK": ("[x] y> tail {k}", "NULL", "'tail ' || k"), "other": ("[a]<b><c> m {k}", "'a'", "'m ' || k"),
}


@query("topic_lines", "SELECT CAST(event_id AS VARCHAR) AS k, CASE event_id % 7 " + " ".join(
    f"WHEN {i} THEN {c}" for i, (_, c, _) in enumerate(_TOPIC_CASE.values())) + " END AS component, CASE event_id % 7 "
    + " ".join(f"WHEN {i} THEN {m}" for i, (_, _, m) in enumerate(_TOPIC_CASE.values()))
    + " END AS message FROM (SELECT *, CAST(event_id AS VARCHAR) AS k FROM events)")
def _(spark, sf):
    k = F.col("event_id").cast("string")
    component = message = None
    for i, (kind, (sample, _, _)) in enumerate(_TOPIC_CASE.items()):
        c, m = parse.topic_line(F.replace(F.lit(sample), F.lit("{k}"), k), kind)
        hit = F.col("event_id") % 7 == i
        component = (F if component is None else component).when(hit, c)
        message = (F if message is None else message).when(hit, m)
    return table(spark, sf, "events").select(k.alias("k"), component.alias("component"), message.alias("message"))


def _files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id"), F.concat_ws("/", F.lit(""), "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file_name"), F.col("text").alias("content"),
        F.md5("text").alias("file_hash"))


@query("content_hashes", "SELECT doc_id, md5(text) AS file_hash FROM documents")
def _(spark, sf):
    return _files(spark, sf).select("doc_id", "file_hash")


@query("lines_with_positions", """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts
    FROM documents))""")
def _(spark, sf):
    return files.lines_of_files(_files(spark, sf)).select("doc_id", "line_no", "line")


_KNOWN = "known AS (SELECT DISTINCT md5(text) AS file_hash FROM documents WHERE doc_id % 4 = 0)"


def _known(spark, sf):
    return _files(spark, sf).where("doc_id % 4 = 0").select("file_hash").distinct()


@query("skip_imported_files", f"""
WITH {_KNOWN} SELECT arg_min(doc_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS doc_id FROM documents
WHERE md5(text) NOT IN (SELECT file_hash FROM known) GROUP BY md5(text)""")
def _(spark, sf):
    return registry.new_files(_files(spark, sf), _known(spark, sf)).select("doc_id")


@query("register_imports", f"""
WITH {_KNOWN} SELECT min(lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS file_name, md5(text) AS file_hash FROM documents
WHERE md5(text) NOT IN (SELECT file_hash FROM known) GROUP BY md5(text)""")
def _(spark, sf):
    return registry.imports(_files(spark, sf), _known(spark, sf), F.current_timestamp()).drop("import_date")


@query("anti_join_registry", f"WITH {_KNOWN} SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT file_hash FROM known)")
def _(spark, sf):
    return _files(spark, sf).join(_known(spark, sf), "file_hash", "left_anti").select("doc_id")


@query("store_fill_ins", """
SELECT id, coalesce(CASE WHEN kind = 1 THEN directory_file END, 'run.log') AS directory_file, 'N/A' AS message,
  md5(coalesce(CASE WHEN kind <> 2 THEN data END, '')) AS data_hash FROM logs""")
def _(spark, sf):
    df = logs(spark, sf).withColumns({
        "directory_file": F.when(F.col("kind") == 1, F.col("directory_file")),
        "data": F.when(F.col("kind") != 2, F.col("data")),
    })
    return store.fill_in(df, F.lit("run.log")).select("id", "directory_file", "message", "data_hash")


@query("bulk_provenance", """
SELECT id, rxid, CASE WHEN kind = 1 THEN 'R9999999999' END AS rxid2,
  rxid || CASE WHEN kind = 1 THEN '_R9999999999' ELSE '' END || '_nal' AS source_table FROM logs WHERE kind <> 2""")
def _(spark, sf):
    df = logs(spark, sf)
    name = F.concat_ws("_", "rxid", F.when(F.col("kind") == 1, "R9999999999"), F.lit("nal"))
    name = F.when(F.col("kind") != 2, name).otherwise(F.lit("nal"))
    return store.with_provenance(df.withColumn("_t", name), F.col("_t")).select("id", "rxid", "rxid2", "source_table")


_FIRST = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rxid, md5(data) ORDER BY directory_file, line_no) AS rn
  FROM logs) WHERE rn = 1)"""


@query("dedupe_first_row", f"WITH {_FIRST} SELECT id, rxid, md5(data) AS data_hash FROM first")
def _(spark, sf):
    return store.dedupe(store.fill_in(logs(spark, sf))).select("id", "rxid", "data_hash")


@query("dedupe_by_message_and_time", """
SELECT min(id) AS id FROM logs GROUP BY rxid, data, date_trunc('day', "timestamp")""")
def _(spark, sf):
    df = store.fill_in(logs(spark, sf)).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return store.dedupe(df, how="data_ts", order=["id"]).select("id")


@query("dedupe_against_store", """
SELECT min(id) AS id FROM logs WHERE id % 2 = 1 AND (rxid, data) NOT IN (SELECT (rxid, data) FROM logs WHERE id % 2 = 0)
GROUP BY rxid, data""")
def _(spark, sf):
    df = store.fill_in(logs(spark, sf))
    stored = df.where("id % 2 = 0")
    return store.dedupe(df.where("id % 2 = 1"), stored, order=["id"]).select("id")


@query("duplicate_counts", f"""
WITH {_FIRST}, k AS (SELECT directory_file, count(*) AS n FROM first GROUP BY directory_file)
SELECT l.directory_file, count(*) AS attempted, coalesce(any_value(k.n), 0) AS inserted, count(*) - coalesce(any_value(k.n), 0) AS duplicates,
  round((count(*) - coalesce(any_value(k.n), 0)) * 100.0::DOUBLE / count(*), 6) AS duplicate_pct
FROM logs l LEFT JOIN k ON k.directory_file = l.directory_file GROUP BY l.directory_file""")
def _(spark, sf):
    df = store.fill_in(logs(spark, sf))
    out = store.duplicate_counts(df, store.dedupe(df))
    return out.withColumn("duplicate_pct", F.round("duplicate_pct", 6))


@query("stack_growing_schemas", """
SELECT id, metric_num, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS BIGINT) AS extra_num FROM logs WHERE dataset = 'main'
UNION ALL SELECT id, NULL, category, NULL FROM logs WHERE dataset = 'good'""")
def _(spark, sf):
    df = logs(spark, sf)
    both = tables.stack([df.where("dataset = 'main'").select("id", "metric_num"), df.where("dataset = 'good'").select("id", "category")])
    return tables.add_missing(both, ["extra_num", "category"])


@query("migrate_columns", """
SELECT id, coalesce(CASE WHEN kind < 5 THEN category END, event_type) AS label, data AS "Data", CAST(NULL AS VARCHAR) AS svc_name FROM logs""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("label", F.when(F.col("kind") < 5, F.col("category")))
    out = tables.spell_columns(tables.migrate_column(df, "event_type", "label"), ["Data", "svc_name"])
    return out.select("id", "label", "Data", "svc_name")


@query("upsert_by_key", """
SELECT rxid AS table_name, count(*) FILTER (dataset = 'main') + count(*) FILTER (dataset = 'good') AS row_count FROM logs
WHERE kind < 5 OR dataset = 'good' GROUP BY rxid HAVING count(*) > 0""")
def _(spark, sf):
    df = logs(spark, sf)
    old = df.where("kind < 5").groupBy(F.col("rxid").alias("table_name")).agg(F.count("*").alias("row_count"))
    new = df.where("dataset = 'good'").groupBy(F.col("rxid").alias("table_name")).agg(F.count("*").alias("row_count"))
    return tables.upsert(old, new, ["table_name"])


def _versions(spark, sf):
    rank = F.row_number().over(W.partitionBy("file_name").orderBy("doc_id")).cast("int")
    d = table(spark, sf, "documents").where("doc_id % 2 = 0")
    return d.select(F.col("source").alias("file_name"), "doc_id", F.md5("text").alias("md5")).withColumn("version_number", rank).drop("doc_id")


_VERSIONS = """versions AS (SELECT source AS file_name, md5(text) AS md5,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS version_number FROM documents WHERE doc_id % 2 = 0)"""


@query("version_status", f"""
WITH {_VERSIONS}, h AS (SELECT file_name, max(version_number) AS highest FROM versions GROUP BY file_name),
u AS (SELECT file_name, md5, max(version_number) AS in_use FROM versions GROUP BY file_name, md5)
SELECT d.doc_id, in_use, highest, CASE WHEN in_use IS NULL THEN 'new' WHEN in_use = highest THEN 'up_to_date' ELSE 'older' END AS status
FROM documents d LEFT JOIN h ON h.file_name = d.source LEFT JOIN u ON u.file_name = d.source AND u.md5 = md5(d.text)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file_name"), F.md5("text").alias("md5"))
    out = registry.version_status(d.select("file_name", "md5").distinct(), _versions(spark, sf))
    return d.join(out, ["file_name", "md5"]).select("doc_id", "in_use", "highest", "status")


@query("next_versions", f"""
WITH {_VERSIONS}, h AS (SELECT file_name, max(version_number) AS highest FROM versions GROUP BY file_name),
d AS (SELECT source AS file_name, max(md5(text)) AS md5 FROM documents GROUP BY source)
SELECT d.file_name, d.md5, CAST(coalesce(highest, 0) + 1 AS INTEGER) AS version_number FROM d LEFT JOIN h USING (file_name)
WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.file_name = d.file_name AND v.md5 = d.md5)""")
def _(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("file_name")).agg(F.max(F.md5("text")).alias("md5"))
    return registry.next_versions(d, _versions(spark, sf))


@query("latest_versions", f"""
WITH {_VERSIONS} SELECT file_name, arg_max(md5, version_number) AS md5, max(version_number) AS version_number FROM versions GROUP BY file_name""")
def _(spark, sf):
    return registry.latest_versions(_versions(spark, sf))


@query("sample_per_receiver", """
SELECT rxid, id FROM (SELECT rxid, id, row_number() OVER (PARTITION BY rxid ORDER BY md5(CAST(id AS VARCHAR))) AS n FROM logs) WHERE n <= 20""")
def _(spark, sf):
    df = logs(spark, sf).select("rxid", "id")
    return top_per_group(df, ["rxid"], [F.md5(F.col("id").cast("string"))], 20)
