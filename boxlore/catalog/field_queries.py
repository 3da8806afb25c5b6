"""Message fields, rule labels and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlore.catalog.registry import query, table
from boxlore.catalog.views import logs
from boxlore.functions.message_fields import display_drop, epg_event, extract_fields, known_event
from boxlore.functions.timestamps import epoch_seconds, in_year_2000
from boxlore.operators import anomaly, enrich, gather, report
from boxlore.sources import tables

_V, _U = "CAST(v AS VARCHAR)", "CAST(u AS VARCHAR)"


def _fields(name: str, columns: dict[str, str]) -> None:
    sql = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())

    @query(f"fields_{name}", f"SELECT id, {sql} FROM logs")
    def _(spark, sf):
        return extract_fields(logs(spark, sf), only=list(columns)).select("id", *columns)


def _number(kind: int) -> str:
    return f"CASE WHEN kind = {kind} THEN {_V} END"


def _long(kind: int) -> str:
    return f"CASE WHEN kind = {kind} THEN v END"


def _counter(name: str, kind: int, column: str) -> None:
    _fields(name, {column: _number(kind), f"{column}_num": _long(kind)})


_fields("customer_mark", {"customer_marked_flag": "CASE WHEN kind = 0 THEN 'YES' END"})
_fields("interface", {
    "interface": f"CASE kind WHEN 1 THEN 'eth' || {_U} WHEN 2 THEN 'wlan' || {_U} END",
    "connection_status": "CASE kind WHEN 1 THEN 'Not Connected' WHEN 2 THEN 'Connected' END",
    "interface_status_code": f"CASE WHEN kind = 1 THEN '-' || {_V} END",
})
_fields("auto_ip", {
    "auto_ip_interface": f"CASE WHEN kind = 3 THEN 'eth' || {_U} END",
    "auto_ip_thread": f"CASE WHEN kind = 3 THEN 'auto ' || {_U} END",
    "auto_ip_event": f"CASE WHEN kind = 3 THEN '-' || {_V} END",
})
_fields("arping", {"arping_ip": f"CASE WHEN kind = 4 THEN '10.0.' || {_U} || '.' || {_V} END"})
_fields("packet_mac", {
    "packet_mac_type": "CASE WHEN kind = 5 THEN 'Source' END",
    "packet_mac": f"CASE WHEN kind = 5 THEN 'aa:bb:cc:dd:' || {_U} || ':' || {_V} END",
})
_fields("arp_details", {
    "arp_details_role": "CASE WHEN kind = 6 THEN 'Sender' END",
    "arp_details_type": "CASE WHEN kind = 6 THEN 'IP' END",
    "arp_details_value": f"CASE WHEN kind = 6 THEN '10.' || {_U} || '.0.' || {_V} END",
})
_fields("sgs_message", {
    "sgs_msg_id": f"CASE WHEN kind = 7 THEN {_U} END",
    "sgs_msg_type": "CASE WHEN kind = 7 THEN 'GET_A' END",
    "sgs_duration_ms": _number(7),
    "sgs_return_code": "CASE WHEN kind = 7 THEN '0' END",
    "sgs_return_desc": "CASE WHEN kind = 7 THEN 'OK' END",
    "sgs_rx_id": f"CASE WHEN kind = 7 THEN 'R' || {_U} || '-x' END",
})
_fields("mac_select", {"mac_select_interface": f"CASE WHEN kind = 8 THEN 'eth' || {_U} END"})
_fields("worker_thread", {
    "worker_thread": f"CASE WHEN kind = 9 THEN 'net' || {_U} || ' thread' END", "worker_thread_version": _long(9),
})
_counter("malloc_occupied", 10, "malloc_occupied")
_counter("free_chunks", 11, "free_chunks")
_counter("topmost_chunk", 12, "topmost_chunk")
_counter("freed_up_bytes", 13, "freed_up_bytes")
_counter("memory_before_gc", 14, "used_memory_before_gc")
_counter("memory_after_gc", 15, "used_memory_after_gc")
_fields("allocated_mmap", {
    "allocated_mmap_bytes": _number(16), "allocated_mmap_bytes_num": _long(16),
    "allocated_mmap_chunks": f"CASE WHEN kind = 16 THEN {_U} END",
    "allocated_mmap_chunks_num": "CASE WHEN kind = 16 THEN u END",
})
_counter("allocated_malloc", 17, "allocated_malloc_bytes")
_fields("svc_name", {"svc_name": f"CASE WHEN kind = 18 THEN 'HBO-' || {_U} END"})
_fields("video_resolution", {
    "video_resolution": "CASE kind WHEN 18 THEN CAST(1000 + u % 9000 AS VARCHAR) || 'x1080' "
                        "WHEN 19 THEN CAST(1000 + u % 9000 AS VARCHAR) || 'x720' END",
})
_fields("msg_type", {
    "msg_type_code": "CASE WHEN kind = 21 THEN u END",
    "msg_type_name": "CASE WHEN kind = 21 THEN 'ES_STB_MSG_TYPE_EPG_CUR_PROGRAM_ALL' END",
})
_fields("msg_class", {"msg_class_code": _long(21), "msg_class_name": "CASE WHEN kind = 21 THEN 'C_X' END"})
_fields("session_ids", {
    "stbh": f"CASE WHEN kind = 21 THEN 'h' || {_U} END", "cid": f"CASE WHEN kind = 21 THEN {_U} END",
    "sid": _number(21), "sessMode": "CASE WHEN kind = 21 THEN '1' END",
})


@query("fields_display_drop", "SELECT id, CAST(CASE WHEN kind = 20 THEN 2 * v ELSE 0 END AS INTEGER) AS display_drop FROM logs")
def _(spark, sf):
    return logs(spark, sf).select("id", display_drop(F.col("data")).alias("display_drop"))


@query("known_event_types", """
SELECT id, CASE WHEN kind = 21 THEN 'EPG_CUR_PROGRAM_ALL' END AS known,
       CASE WHEN kind = 24 THEN 'epg_handle_issue' END AS epg FROM logs""")
def _(spark, sf):
    df = extract_fields(logs(spark, sf), only=["msg_type_name"])
    return df.select("id", known_event(F.col("msg_type_name")).alias("known"), epg_event(F.col("data")).alias("epg"))


_RULE_EVENT = "CASE kind WHEN 0 THEN 'MARKED_LOGS' WHEN 21 THEN 'EPG_CUR_PROGRAM_ALL' ELSE event_type END"


@query("enrich_rule_labels", f"""
WITH r AS (SELECT id, kind, {_RULE_EVENT} AS e FROM logs)
SELECT id, CASE WHEN kind IN (19, 22) THEN coalesce(e || ', ', '') || 'signal_protector' ELSE e END AS event_type,
       CASE WHEN kind = 0 THEN 'YES' END AS customer_marked_flag FROM r""")
def _(spark, sf):
    return enrich.enrich(logs(spark, sf)).select("id", "event_type", "customer_marked_flag")


@query("signal_protector_once", """
SELECT id, CASE WHEN kind IN (19, 22) THEN coalesce(event_type || ', ', '') || 'signal_protector' ELSE event_type END
  AS event_type FROM logs""")
def _(spark, sf):
    # applied twice: the label must not be added again
    return enrich.protect_signal(enrich.protect_signal(logs(spark, sf))).select("id", "event_type")


@query("project_length_epoch", """
SELECT id, CAST(coalesce(length(data), 0) AS INTEGER) AS data_len, epoch_us("timestamp") / 1e6 AS ts_epoch FROM logs""")
def _(spark, sf):
    return logs(spark, sf).select(
        "id", anomaly.data_length().alias("data_len"), epoch_seconds(F.col("timestamp")).alias("ts_epoch"))


@query("project_coalesce", """
SELECT id, coalesce(event_type, category) AS kind_name, coalesce(CASE WHEN kind = 0 THEN metric_num END, 0) AS score
FROM logs""")
def _(spark, sf):
    score = F.coalesce(F.when(F.col("kind") == 0, F.col("metric_num")), F.lit(0.0))
    return logs(spark, sf).select("id", F.coalesce("event_type", "category").alias("kind_name"), score.alias("score"))


@query("filter_receivers_in", """
SELECT rxid, count(*) AS n FROM logs WHERE rxid IN ('R0000000003', 'R0000000008', 'R0000000046') GROUP BY rxid""")
def _(spark, sf):
    picked = tables.of_receivers(logs(spark, sf), ["R0000000003", "R0000000008", "R0000000046"])
    return picked.groupBy("rxid").agg(F.count("*").alias("n"))


@query("filter_labelled_rows", """
SELECT event_type, count(*) AS n FROM logs WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY event_type""")
def _(spark, sf):
    from boxlore.operators.classify import training_rows

    return training_rows(logs(spark, sf), ["data"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("scan_time_range", """
SELECT id, rxid, "timestamp" FROM logs
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
def _(spark, sf):
    import datetime as dt

    start, end = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 12)
    df = tables.between(logs(spark, sf), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return df.select("id", "rxid", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("scan_optional_bound", """
SELECT count(*) AS n_from, (SELECT count(*) FROM logs) AS n_all FROM logs
WHERE "timestamp" >= TIMESTAMP '2024-01-20 00:00:00'""")
def _(spark, sf):
    import datetime as dt

    df = logs(spark, sf)
    from_date = tables.between(df, F.lit(dt.datetime(2024, 1, 20)).cast("timestamp"), None)
    everything = tables.between(df, None, None).agg(F.count("*").alias("n_all"))
    return from_date.agg(F.count("*").alias("n_from")).withColumn("n_all", everything.scalar())


@query("receivers_present", "SELECT DISTINCT rxid FROM logs")
def _(spark, sf):
    return tables.receivers(logs(spark, sf))


_FLAGGED = """f AS (
  SELECT *, metric_num > 300 AS recon_is_anomaly, CASE WHEN kind = 3 THEN metric_num - 50 END AS significance_score,
         CASE WHEN kind = 0 THEN 'YES' WHEN kind = 1 THEN '' END AS customer_marked_flag,
         CASE WHEN kind = 5 THEN true WHEN kind = 6 THEN false END AS important_investigate FROM logs)"""
_FLAG_TEST = """(recon_is_anomaly OR coalesce(significance_score > 0, false)
  OR CAST(coalesce(nullif(customer_marked_flag, ''), 'false') AS BOOLEAN) OR coalesce(important_investigate, false))"""
_FLAG_TEST = _FLAG_TEST.replace("CAST(coalesce(nullif(customer_marked_flag, ''), 'false') AS BOOLEAN)",
                                "coalesce(customer_marked_flag = 'YES', false)")


def flagged(spark, sf):
    k = F.col("kind")
    return logs(spark, sf).withColumns({
        "recon_is_anomaly": F.col("metric_num") > 300,
        "significance_score": F.when(k == 3, F.col("metric_num") - 50),
        "customer_marked_flag": F.when(k == 0, "YES").when(k == 1, ""),
        "important_investigate": F.when(k == 5, True).when(k == 6, False),
    })


@query("anomaly_predicate", f"WITH {_FLAGGED} SELECT id, {_FLAG_TEST} AS is_anomaly FROM f")
def _(spark, sf):
    df = flagged(spark, sf)
    return df.select("id", gather.anomaly_predicate(df).alias("is_anomaly"))


@query("gather_anomalies", f"WITH {_FLAGGED} SELECT rxid AS table_name, id, significance_score FROM f WHERE {_FLAG_TEST}")
def _(spark, sf):
    return gather.gather(flagged(spark, sf)).select("table_name", "id", "significance_score")


@query("gather_tables_by_name", f"""
WITH {_FLAGGED}
SELECT 'main' AS table_name, id, recon_is_anomaly, CAST(NULL AS DOUBLE) AS seq_score FROM f
  WHERE dataset = 'main' AND recon_is_anomaly
UNION ALL
SELECT 'good', id, NULL, metric_num - 400 FROM f WHERE dataset = 'good' AND metric_num > 400""")
def _(spark, sf):
    df = flagged(spark, sf)
    main = df.where("dataset = 'main'").select("id", "recon_is_anomaly")
    good = df.where("dataset = 'good'").select("id", (F.col("metric_num") - 400).alias("seq_score"))
    plain = df.select("id")
    return gather.gather_tables({"main": main, "good": good, "plain": plain}).select(
        "table_name", "id", "recon_is_anomaly", "seq_score")


@query("anomalies_per_receiver", f"""
WITH {_FLAGGED} SELECT rxid, CAST(sum(CASE WHEN {_FLAG_TEST} THEN 1 ELSE 0 END) AS BIGINT) AS anomalies FROM f GROUP BY rxid""")
def _(spark, sf):
    return gather.anomaly_counts(flagged(spark, sf))


@query("anomaly_colours", f"""
WITH {_FLAGGED}, s AS (SELECT *, value_gt AS seq_is_anomaly FROM (SELECT *, CASE WHEN kind % 2 = 0 THEN v > 20 END AS value_gt FROM f))
SELECT id, CASE WHEN kind = 24 THEN 'green' WHEN kind = 22 THEN 'yellow'
  WHEN recon_is_anomaly AND coalesce(seq_is_anomaly, false) THEN 'black' WHEN recon_is_anomaly THEN 'red'
  WHEN coalesce(seq_is_anomaly, false) THEN 'orange' ELSE 'blue' END AS colour FROM s""")
def _(spark, sf):
    df = flagged(spark, sf).withColumns({
        "seq_is_anomaly": F.when(F.col("kind") % 2 == 0, F.col("v") > 20),
        "message": F.col("data"),
        "event_type": F.when(F.col("kind") == 22, "x, signal_protector"),
    })
    return df.select("id", report.colour().alias("colour"))


@query("severity_ladder", """
SELECT id, CASE WHEN NOT metric_num / 100 > 0.5 THEN 'normal' WHEN metric_num / 100 - 0.5 > 0.2 THEN 'critical'
  WHEN metric_num / 100 - 0.5 > 0.1 THEN 'warning' ELSE 'anomaly' END AS issue FROM logs""")
def _(spark, sf):
    score = F.col("metric_num") / 100
    return logs(spark, sf).select("id", anomaly.severity(score > 0.5, score, F.lit(0.5)).alias("issue"))


@query("drop_null_rows", """
SELECT (SELECT count(*) FROM logs WHERE event_type IS NOT NULL OR kind <> 0) AS n_all,
       (SELECT count(*) FROM logs WHERE event_type IS NOT NULL AND kind <> 0) AS n_any""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("k", F.nullif("kind", F.lit(0)))
    either = df.dropna(how="all", subset=["event_type", "k"]).agg(F.count("*").alias("n_all"))
    both = df.dropna(how="any", subset=["event_type", "k"]).agg(F.count("*").alias("n_any"))
    return either.withColumn("n_any", both.scalar())


@query("scalar_suite", """
SELECT id, make_timestamp(2000, month("timestamp"), day("timestamp"), hour("timestamp"), minute("timestamp"),
         CAST(epoch_us("timestamp") % 60000000 AS DOUBLE) / 1e6) AS no_year,
       CAST(date_trunc('day', "timestamp") AS DATE) AS day_start, greatest(5.0, least(30.0, metric_num)) AS clipped,
       coalesce(nullif(CASE WHEN kind = 0 THEN 'true' ELSE '' END, ''), 'false') = 'true' AS flag,
       TRY_CAST(CASE WHEN kind = 4 THEN '12.5' ELSE 'x' END AS DOUBLE) AS number,
       CAST(user_prop AS INTEGER) AS k
FROM (SELECT l.*, json_extract_string(e.props, '$.k') AS user_prop FROM logs l JOIN events e ON e.event_id = l.id)""")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 26
    text = F.when(kind == 0, F.lit("true")).otherwise("")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        in_year_2000(ts).cast("timestamp_ntz").alias("no_year"),
        F.date_trunc("day", ts).cast("date").alias("day_start"),
        F.greatest(F.lit(5.0), F.least(F.lit(30.0), F.col("value"))).alias("clipped"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit("false")).try_cast("boolean").alias("flag"),
        F.when(kind == 4, F.lit("12.5")).otherwise("x").try_cast("double").alias("number"),
        F.from_json("props", "k int")["k"].alias("k"),
    )
