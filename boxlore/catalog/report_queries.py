"""Counts, pivots, imputation, graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlore.catalog.registry import query
from boxlore.catalog.views import logs
from boxlore.functions.message_fields import extract_fields
from boxlore.operators import gather, graph, report
from boxlore.plans.median import exact_median


@query("row_counts", "SELECT rxid AS table_name, count(*) AS row_count FROM logs GROUP BY rxid")
def _(spark, sf):
    return report.row_counts(logs(spark, sf))


@query("largest_receivers", """
SELECT rxid AS table_name, count(*) AS row_count FROM logs GROUP BY rxid ORDER BY row_count DESC, table_name LIMIT 20""")
def _(spark, sf):
    return report.largest(report.row_counts(logs(spark, sf)))


@query("row_counts_ordered", "SELECT rxid AS table_name, count(*) AS row_count FROM logs GROUP BY rxid ORDER BY row_count DESC")
def _(spark, sf):
    return report.row_counts(logs(spark, sf)).orderBy(F.desc("row_count"), "table_name")


@query("newest_per_file", """
SELECT directory_file, epoch_us(max("timestamp")) AS max_us, count(*) AS n FROM logs GROUP BY directory_file""")
def _(spark, sf):
    out = report.newest_and_count(logs(spark, sf), "directory_file")
    return out.select("directory_file", F.unix_micros("max_ts").alias("max_us"), "n")


@query("daily_receiver_counts", """
SELECT CAST("timestamp" AS DATE) AS day, rxid, count(*) AS n FROM logs GROUP BY 1, 2""")
def _(spark, sf):
    return report.daily_counts(logs(spark, sf).withColumn("significance_score", F.col("metric_num")))


@query("daily_receiver_pivot", """
SELECT CAST("timestamp" AS DATE) AS day, count(*) FILTER (rxid = 'R0000000001') AS "R0000000001",
  count(*) FILTER (rxid = 'R0000000008') AS "R0000000008", count(*) FILTER (rxid = 'R0000000046') AS "R0000000046"
FROM logs WHERE rxid IN ('R0000000001', 'R0000000008', 'R0000000046') GROUP BY 1""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("significance_score", F.col("metric_num"))
    return report.daily_pivot(df, ["R0000000001", "R0000000008", "R0000000046"])


@query("median_timestamp", """
SELECT (a + b) / 2 AS median FROM (SELECT CAST(quantile_disc(x, 0.5) AS DOUBLE) AS a,
  CAST((SELECT x FROM u ORDER BY x LIMIT 1 OFFSET (SELECT count(*) // 2 FROM u)) AS DOUBLE) AS b FROM u)""".replace(
    "SELECT (a", "WITH u AS (SELECT epoch_us(\"timestamp\") AS x FROM logs WHERE kind <> 9) SELECT (a"))
def _(spark, sf):
    return exact_median(logs(spark, sf).where("kind <> 9"), F.unix_micros("timestamp"))


@query("impute_median_timestamp", """
WITH m AS (SELECT CAST(floor(median(epoch_us("timestamp"))) AS BIGINT) AS m FROM logs WHERE kind <> 9)
SELECT id, CASE WHEN kind = 9 THEN m ELSE epoch_us("timestamp") END AS us FROM logs, m""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("timestamp", F.when(F.col("kind") != 9, F.col("timestamp")))
    return report.impute_median(df).select("id", F.unix_micros("timestamp").alias("us"))


@query("marker_sizes", """
WITH s AS (SELECT id, CAST(CASE WHEN kind = 7 THEN v ELSE 1 END AS DOUBLE) AS x FROM logs)
SELECT id, round(greatest(5.0, least(30.0, x / (SELECT max(x) FROM s) * 20)), 6) AS size FROM s""")
def _(spark, sf):
    df = extract_fields(logs(spark, sf), only=["sgs_duration_ms"])
    return report.marker_sizes(df).select("id", F.round("size", 6).alias("size"))


@query("correlation_view", """
SELECT id, coalesce(CASE WHEN kind = 7 THEN metric_num END, 0) AS significance_score,
  CASE WHEN kind = 7 THEN CAST(v AS VARCHAR) END AS sgs_duration_ms FROM logs""")
def _(spark, sf):
    df = extract_fields(logs(spark, sf), only=["sgs_duration_ms"]).withColumns({
        "significance_score": F.when(F.col("kind") == 7, F.col("metric_num")),
        "recon_is_anomaly": F.lit(False), "seq_is_anomaly": F.lit(False), "message": F.col("id").cast("string"),
    })
    out = report.correlation_view(df)
    return out.select(F.col("message").cast("bigint").alias("id"), "significance_score", "sgs_duration_ms")


@query("anomalies_newest_first", """
SELECT rxid AS table_name, id FROM logs WHERE metric_num > 200 ORDER BY "timestamp" DESC""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("a_score", F.col("metric_num") - 200)
    return gather.gather(df).orderBy(F.desc("timestamp"), "id").select("table_name", "id")


@query("first_rows_by_time", """
SELECT id, rxid FROM logs ORDER BY "timestamp", id LIMIT 500""")
def _(spark, sf):
    return logs(spark, sf).orderBy("timestamp", "id").limit(500).select("id", "rxid")


_GRAPH = """g AS (SELECT *, CASE WHEN category = 'view' THEN 'UNKNOWN' ELSE category END AS cat,
   CASE WHEN kind = 21 THEN CAST(v AS VARCHAR) END AS sid, CASE WHEN kind = 21 THEN CAST(u AS VARCHAR) END AS cid,
   strftime(date_trunc('day', "timestamp"), '%Y-%m-%dT00:00:00.000000') AS day_text FROM logs),
 k AS (SELECT *, day_text || '_' || cat || '_' || md5(data) AS key FROM g)"""


def _graph_rows(spark, sf):
    # days instead of exact stamps, so that lines really repeat
    df = logs(spark, sf).withColumns({
        "category": F.nullif("category", F.lit("view")), "timestamp": F.date_trunc("day", "timestamp"),
    })
    return extract_fields(df, only=["sid", "cid"])


@query("graph_line_nodes", f"""
WITH {_GRAPH} SELECT key AS id, arg_min(data, (directory_file, line_no)) AS data,
  coalesce(arg_min(coalesce(event_type, '-'), (directory_file, line_no)), '-') AS event_type FROM k GROUP BY key""")
def _(spark, sf):
    out = graph.line_nodes(_graph_rows(spark, sf))
    return out.select("id", "data", F.coalesce("event_type", F.lit("-")).alias("event_type"))


@query("graph_named_nodes", f"""
WITH {_GRAPH} SELECT DISTINCT cat AS id, 'Process' AS label FROM k
UNION ALL SELECT DISTINCT sid, 'Session' FROM k WHERE sid IS NOT NULL
UNION ALL SELECT DISTINCT cid, 'Connection' FROM k WHERE cid IS NOT NULL""")
def _(spark, sf):
    return graph.named_nodes(_graph_rows(spark, sf))


@query("graph_nodes", f"""
WITH {_GRAPH} SELECT label, count(*) AS n, CAST(sum(length(id)) AS BIGINT) AS id_chars FROM (
  SELECT DISTINCT key AS id, 'LogLine' AS label FROM k UNION ALL SELECT DISTINCT cat, 'Process' FROM k
  UNION ALL SELECT DISTINCT sid, 'Session' FROM k WHERE sid IS NOT NULL
  UNION ALL SELECT DISTINCT cid, 'Connection' FROM k WHERE cid IS NOT NULL) GROUP BY label""")
def _(spark, sf):
    return graph.nodes(_graph_rows(spark, sf)).groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.length("id")).alias("id_chars"))


@query("graph_edges", f"""
WITH {_GRAPH} SELECT DISTINCT cat AS src, key AS dst, 'GENERATED' AS rel FROM k
UNION ALL SELECT DISTINCT key, sid, 'PART_OF_SESSION' FROM k WHERE sid IS NOT NULL
UNION ALL SELECT DISTINCT key, cid, 'ASSOCIATED_WITH' FROM k WHERE cid IS NOT NULL""")
def _(spark, sf):
    return graph.edges(_graph_rows(spark, sf))
