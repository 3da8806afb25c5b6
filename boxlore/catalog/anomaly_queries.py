"""Significance, thresholds, sequences, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boxlore.catalog.registry import query
from boxlore.catalog.views import logs
from boxlore.operators import anomaly, gather, network, report, sessions, significance
from boxlore.operators.classify import model_path
from boxlore.plans.ordered import SEGMENT, ranked_blocks, time_slice
from boxlore.session import checkpoint_dir


def marked(spark, sf):
    mark = (F.col("category") == "error") & (F.col("metric_num") > 60)
    return logs(spark, sf).withColumn("customer_marked_flag", F.when(mark, "YES"))


_MARKS = """m AS (
  SELECT *, CAST(sum(CASE WHEN category = 'error' AND metric_num > 60 THEN 1 ELSE 0 END) OVER (
    PARTITION BY rxid ORDER BY "timestamp" RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING)
    AS BIGINT) AS marks FROM logs)"""


@query("boost_around_marks", f"""
WITH {_MARKS} SELECT id, CASE WHEN marks > 0 THEN 5.0 * marks ELSE NULL END::DOUBLE AS significance_score,
  CASE WHEN marks > 0 THEN true END AS important_investigate FROM m""")
def _(spark, sf):
    out = significance.boost_marked(marked(spark, sf), minutes=360)
    return out.select("id", "significance_score", "important_investigate")


@query("marked_days_per_receiver", f"""
WITH {_MARKS} SELECT CAST("timestamp" AS DATE) AS day, rxid, count(*) AS n FROM m WHERE marks > 0 GROUP BY 1, 2""")
def flagship(spark, sf):
    """Marks -> boost -> anomaly predicate -> gathered table -> day x receiver counts."""
    boosted = significance.boost_marked(marked(spark, sf).withColumn("customer_marked_flag",
                                        F.col("customer_marked_flag")), minutes=360)
    return report.daily_counts(gather.gather(boosted))


@query("significance_scores", """
WITH n AS (SELECT rxid, id, metric_num AS a, CAST(nullif(v, 3) AS DOUBLE) AS b, CASE WHEN kind <> 4 THEN 1.0 END AS c FROM logs),
r AS (SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM n
      WINDOW w AS (PARTITION BY rxid)),
s AS (SELECT id, CASE WHEN la = ha THEN 0 ELSE (a - la) / (ha - la) END AS x,
        CASE WHEN b IS NULL THEN NULL WHEN lb = hb THEN 0 ELSE (b - lb) / (hb - lb) END AS y,
        CASE WHEN c IS NOT NULL THEN 0 END AS z FROM r)
SELECT id, round((x + coalesce(y, 0) + coalesce(z, 0)) / (1 + (y IS NOT NULL)::INT + (z IS NOT NULL)::INT), 6)
  AS significance_score FROM s""")
def _(spark, sf):
    df = logs(spark, sf).select(
        "rxid", "id", F.col("metric_num").alias("a"), F.nullif("v", F.lit(3)).alias("b"),
        F.when(F.col("kind") != 4, F.lit(1.0)).alias("c"))
    out = significance.significance(df)
    return out.select("id", F.round("significance_score", 6).alias("significance_score"))


_LEN = "CAST(length(data) AS DOUBLE)"


@query("threshold_two_sigma", """
WITH t AS (SELECT avg(metric_num) + 2 * stddev_pop(metric_num) AS th FROM logs)
SELECT id, round(th, 6) AS threshold, metric_num > th AS is_anomaly FROM logs, t""")
def _(spark, sf):
    out = anomaly.add_threshold(logs(spark, sf), "metric_num", [])
    return out.select("id", F.round("threshold", 6).alias("threshold"), "is_anomaly")


@query("threshold_per_receiver", """
WITH t AS (SELECT rxid, avg(metric_num) + 2 * stddev_pop(metric_num) AS th FROM logs GROUP BY rxid)
SELECT id, metric_num > th AS is_anomaly FROM logs JOIN t USING (rxid)""")
def _(spark, sf):
    return anomaly.add_threshold(logs(spark, sf), "metric_num", ["rxid"]).select("id", "is_anomaly")


@query("min_max_losses", """
WITH r AS (SELECT rxid, id, metric_num, min(metric_num) OVER w AS lo, max(metric_num) OVER w AS hi FROM logs
           WINDOW w AS (PARTITION BY rxid)),
n AS (SELECT rxid, id, CASE WHEN hi > lo THEN (metric_num - lo) / (hi - lo) ELSE metric_num END AS s FROM r)
SELECT id, round(s, 6) AS score, round(avg(s) OVER p + 2 * stddev_pop(s) OVER p, 6) AS threshold FROM n
WINDOW p AS (PARTITION BY rxid)""")
def _(spark, sf):
    scaled = anomaly.min_max(logs(spark, sf), "metric_num", ["rxid"], "score")
    out = anomaly.add_threshold(scaled, "score", ["rxid"])
    return out.select("id", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"))


@query("standard_scaling", f"""
WITH s AS (SELECT id, {_LEN} AS x, avg({_LEN}) OVER w AS m, stddev_pop({_LEN}) OVER w AS d FROM logs
           WINDOW w AS (PARTITION BY rxid))
SELECT id, round(CASE WHEN d = 0 THEN 0 ELSE (x - m) / d END, 6) + 0.0 AS z FROM s""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("x", F.length("data").cast("double"))
    out = anomaly.standardize(df, {"x": "z"}, ["rxid"])
    return out.select("id", (F.round("z", 6) + 0.0).alias("z"))


@query("reconstruction_error", f"""
WITH s AS (SELECT rxid, id, {_LEN} AS x, avg({_LEN}) OVER w AS m, stddev_pop({_LEN}) OVER w AS d FROM logs
           WINDOW w AS (PARTITION BY rxid)),
e AS (SELECT rxid, id, CASE WHEN d = 0 THEN 0 ELSE ((x - m) / d) * ((x - m) / d) END AS e FROM s)
SELECT id, round(e, 6) AS recon_score, round(avg(e) OVER p + 2 * stddev_pop(e) OVER p, 6) AS recon_threshold
FROM e WINDOW p AS (PARTITION BY rxid)""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("data_len", anomaly.data_length().cast("double"))
    out = anomaly.reconstruction_scores(df, ["data_len"])
    return out.select("id", F.round("recon_score", 6).alias("recon_score"), F.round("recon_threshold", 6).alias("recon_threshold"))


@query("reconstruction_axes")
def _(spark, sf):
    df = logs(spark, sf).withColumn("data_len", anomaly.data_length().cast("double"))
    z = anomaly.standardize(df, {"data_len": "zl", "metric_num": "zv", "line_no": "zn"}, [])
    model = anomaly.fit_reconstruction(z.where("dataset = 'good'"), ["zl", "zv", "zn"], 2)
    return anomaly.score_reconstruction(model, z.where("dataset = 'main'")).select("id", "recon_score", "recon_is_anomaly")


_SEQ = f"""q AS (
  SELECT rxid, id, "timestamp" AS ts, {_LEN} AS data_len,
    coalesce((epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER w) / 1e6, 0) AS delta_s, row_number() OVER w AS rn
  FROM logs WINDOW w AS (PARTITION BY rxid ORDER BY "timestamp", id))"""


@query("time_deltas", f"WITH {_SEQ} SELECT id, round(delta_s, 6) AS delta_s FROM q")
def _(spark, sf):
    rows = anomaly.sequence_rows(logs(spark, sf)).where("NOT _copy")
    return rows.select("id", F.round("delta_s", 6).alias("delta_s"))


@query("sliding_sequences", f"""
WITH {_SEQ} SELECT id, CAST(16 AS INTEGER) AS n, round(sl, 6) AS sum_len, round(sd, 3) AS sum_delta, first_len FROM (
  SELECT id, rn, sum(data_len) OVER w AS sl, sum(delta_s) OVER w AS sd, first_value(data_len) OVER w AS first_len FROM q
  WINDOW w AS (PARTITION BY rxid ORDER BY ts, id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) WHERE rn >= 16""")
def _(spark, sf):
    total = lambda field: F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[field])
    return anomaly.sequences(logs(spark, sf)).select(
        "id", F.size("sequence").alias("n"), F.round(total("data_len"), 6).alias("sum_len"),
        F.round(total("delta_s"), 3).alias("sum_delta"), F.col("sequence")[0]["data_len"].alias("first_len"))


@query("sequence_forecast_mean", f"""
WITH {_SEQ}, b AS (SELECT *, avg(data_len) OVER p AS bl, avg(delta_s) OVER p AS bd,
    stddev_pop(data_len) OVER r AS dl, stddev_pop(delta_s) OVER r AS dd FROM q
  WINDOW p AS (PARTITION BY rxid ORDER BY ts, id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY rxid)),
e AS (SELECT rxid, id, (CASE WHEN dl = 0 THEN 0 ELSE power((data_len - bl) / dl, 2) END
    + CASE WHEN dd = 0 THEN 0 ELSE power((delta_s - bd) / dd, 2) END) / 2 AS e FROM b WHERE rn >= 16),
n AS (SELECT rxid, id, CASE WHEN max(e) OVER r > min(e) OVER r THEN (e - min(e) OVER r) / (max(e) OVER r - min(e) OVER r)
    ELSE e END AS s FROM e WINDOW r AS (PARTITION BY rxid)),
t AS (SELECT id, s, avg(s) OVER r + 2 * stddev_pop(s) OVER r AS th FROM n WINDOW r AS (PARTITION BY rxid))
SELECT id, round(s, 6) AS seq_score, round(th, 6) AS seq_threshold, s > th AS seq_is_anomaly,
  CASE WHEN NOT s > th THEN 'normal' WHEN s - th > 0.2 THEN 'critical' WHEN s - th > 0.1 THEN 'warning' ELSE 'anomaly' END
  AS seq_issue FROM t""")
def _(spark, sf):
    out = anomaly.score_sequences(logs(spark, sf))
    return out.select("id", F.round("seq_score", 6).alias("seq_score"), F.round("seq_threshold", 6).alias("seq_threshold"),
                      "seq_is_anomaly", "seq_issue")


@query("sequence_forecast_linear")
def _(spark, sf):
    df = logs(spark, sf)
    models = anomaly.fit_forecaster(df.where("dataset = 'good'"))
    return anomaly.score_forecast(models, df.where("dataset = 'main'")).select("rxid", "id", "seq_score", "seq_issue")


@query("sequence_forecast_recurrent", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY rxid ORDER BY "timestamp", id) AS place FROM logs WHERE dataset = 'main')
SELECT id, rxid, true AS scaled, true AS loss_fell, true AS same_again FROM r WHERE place >= 16""")
def _(spark, sf):
    """Trained on good rows, saved, loaded, and applied to the others: which rows get a score, and that it behaves."""
    df = logs(spark, sf)
    folder = f"{checkpoint_dir(spark)}/networks/{uuid.uuid4().hex}"
    model = anomaly.fit_recurrent(df.where("dataset = 'good'"), steps=2)
    path = model_path(folder, "sequence", length=anomaly.SEQUENCE, hidden=model.network.hidden)
    model.save(spark, path)
    loaded = network.load(spark, path)
    scores = anomaly.score_recurrent(loaded, df.where("dataset = 'main'"))
    return scores.select(
        "id", "rxid", F.col("seq_score").between(0, 1).alias("scaled"), F.lit(model.losses[-1] < model.losses[0]).alias("loss_fell"),
        F.lit(bool((loaded.weights == model.weights).all())).alias("same_again"))


@query("reconstruction_network", """
SELECT id, rxid, true AS scored, true AS loss_fell FROM logs WHERE dataset = 'main'""")
def _(spark, sf):
    """A non-linear auto-encoder, trained on good rows, over the rows of the others."""
    columns = ["data_len", "metric_num"]
    df = logs(spark, sf).withColumn("data_len", F.length("data").cast("double")).select("rxid", "id", "dataset", *columns)
    model = anomaly.fit_autoencoder(df.where("dataset = 'good'"), columns, steps=2)
    scores = anomaly.score_autoencoder(model, df.where("dataset = 'main'"), columns)
    return scores.select("id", "rxid", (F.col("recon_score") >= 0).alias("scored"), F.lit(model.losses[-1] < model.losses[0]).alias("loss_fell"))


@query("scores_joined_back", f"""
WITH s AS (SELECT rxid, id, CAST(length(data) AS INTEGER) AS data_len FROM logs WHERE kind < 10)
SELECT l.id, s.data_len FROM logs l LEFT JOIN s ON s.rxid = l.rxid AND s.id = l.id""")
def _(spark, sf):
    df = logs(spark, sf)
    scores = df.where("kind < 10").select("rxid", "id", anomaly.data_length().alias("data_len"))
    return anomaly.attach_scores(df, scores).select("id", "data_len")


@query("score_histogram", """
WITH s AS (SELECT min(metric_num) AS lo, max(metric_num) AS hi, avg(metric_num) + 2 * stddev_pop(metric_num) AS th FROM logs)
SELECT CAST(least(floor((metric_num - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n,
  round(any_value(th), 6) AS threshold FROM logs, s GROUP BY 1""")
def _(spark, sf):
    return anomaly.histogram(logs(spark, sf), "metric_num").select("bin", "n", F.round("threshold", 6).alias("threshold"))


@query("row_numbers_in_blocks", """
SELECT id, row_number() OVER (PARTITION BY rxid ORDER BY "timestamp", id) AS n FROM logs""")
def _(spark, sf):
    df = logs(spark, sf).withColumn(SEGMENT, time_slice(F.col("timestamp")))
    return ranked_blocks(df, ["rxid"], ["timestamp", "id"], 0).select("id", F.col("_rank").alias("n"))


_SESSION = """s AS (
  SELECT *, kind = 18 AS m, CAST(sum(CASE WHEN kind = 18 THEN 1 ELSE 0 END) OVER (
    PARTITION BY rxid ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM logs)"""


@query("session_numbers", f"WITH {_SESSION} SELECT id, m AS is_marker, session_no FROM s")
def _(spark, sf):
    return sessions.number_sessions(logs(spark, sf)).select("id", "is_marker", "session_no")


@query("session_numbers_by_event", """
SELECT id, CAST(sum(CASE WHEN category = 'signup' THEN 1 ELSE 0 END) OVER (
  PARTITION BY rxid ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM logs""")
def _(spark, sf):
    return sessions.number_sessions(logs(spark, sf), F.col("category") == "signup").select("id", "session_no")


@query("session_alerts", f"""
WITH {_SESSION}
SELECT rxid, session_no, epoch_us(min("timestamp")) AS start_us,
  max(CASE WHEN m THEN 'HBO-' || CAST(u AS VARCHAR) END) AS svc_name,
  max(CASE WHEN m THEN CAST(1000 + u % 9000 AS VARCHAR) || 'x1080' END) AS video_resolution,
  count(*) FILTER (kind = 22) AS "BlackScreen", count(*) FILTER (kind = 23) AS "VideoFreeze",
  count(*) FILTER (kind = 20 AND 2 * v < 100) AS "DisplayDrop_0_99",
  count(*) FILTER (kind = 20 AND 2 * v >= 100 AND 2 * v < 300) AS "DisplayDrop_100_299",
  count(*) FILTER (kind = 20 AND 2 * v >= 300 AND 2 * v < 500) AS "DisplayDrop_300_499",
  count(*) FILTER (kind = 20 AND 2 * v >= 500 AND 2 * v < 700) AS "DisplayDrop_500_699",
  count(*) FILTER (kind = 20 AND 2 * v >= 700) AS "DisplayDrop_700_plus",
  count(*) FILTER (kind IN (23, 25)) AS n_other_events
FROM s GROUP BY rxid, session_no""")
def _(spark, sf):
    out = sessions.session_summary(sessions.number_sessions(logs(spark, sf)))
    start = F.unix_micros("change_content_timestamp").alias("start_us")
    return out.select(*[c for c in out.columns if c != "change_content_timestamp"], start)


@query("session_other_events", f"""
WITH {_SESSION} SELECT rxid, session_no, id, trim(data) AS description FROM s WHERE kind IN (23, 25)""")
def _(spark, sf):
    out = sessions.session_events(sessions.number_sessions(logs(spark, sf)))
    return out.select("rxid", "session_no", "id", "description")


@query("session_documents", f"""
WITH {_SESSION}
SELECT rxid, session_no, CAST(0 AS BIGINT) AS part, CAST(count(*) FILTER (kind = 22) AS INTEGER) AS black,
  CAST(count(*) FILTER (kind IN (23, 25)) AS INTEGER) AS n_events,
  arg_min(trim(data), (epoch_us("timestamp"), id)) FILTER (kind IN (23, 25)) AS first_event
FROM s GROUP BY rxid, session_no""")
def _(spark, sf):
    out = sessions.session_documents(sessions.number_sessions(logs(spark, sf)))
    read = F.from_json("analysis_json", "alerts struct<BlackScreen:int>, other_events array<struct<description:string>>")
    out = out.withColumn("d", read)
    events = F.col("d.other_events")
    return out.select("rxid", "session_no", "part", F.col("d.alerts.BlackScreen").alias("black"),
                      F.size(events).alias("n_events"), F.try_element_at(events, F.lit(1))["description"].alias("first_event"))
