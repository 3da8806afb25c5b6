"""Log-shaped views of the given tables, in Spark and as the same SQL.

``logs``   one log row per event; the message is a sentence picked by event_id
           with numbers of the row put in, so every extractor finds its text.
``lines``  one raw text line per event, in the nine line formats by turns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxlore.sources.tables import spread

# placeholders: u user_id, v floor(value), d 2*v, w four-digit width, k event_id
MESSAGES = [
    "DUMPING FILE /tmp/d{u}.bin",
    "Interface eth{u} Not Connected(-{v})",
    "Interface wlan{u} Connected",
    "Need to start Auto IP thread for eth{u}, thread (auto {u}), event -{v}",
    "Arping for 10.0.{u}.{v}",
    "Source MAC: aa:bb:cc:dd:{u}:{v}",
    "Sender IP : 10.{u}.0.{v}",
    "SGS Msg <{u}:GET_A> took <{v} ms> SGS Return Code:<0:OK> rx_id:<R{u}-x>",
    "MAC Select thread running on <eth{u}> interface",
    "starting thread:<net{u} thread>, version:<{v}>",
    "This is the total size of memory occupied by chunks handed out by malloc:{v}",
    "This is the total size of memory occupied by free (not in use) chunks.:{v}",
    "This is the size of the top-most releasable chunk (trim):{v}",
    "Freed up bytes: {v}",
    "Used memory before GC: {v}",
    "Used memory after GC: {v}",
    "Allocated {v} bytes in {u} chunks. (via mmap)",
    "Allocated {v} bytes for heap (via malloc)",
    "CHANGE_CONTENT svc_name = HBO-{u} Video Resolution: {w}x1080",
    "Video Resolution: {w}x720 on llot feed",
    "Display Drop Detected = {d}",
    "Type:<{u}:ES_STB_MSG_TYPE_EPG_CUR_PROGRAM_ALL> Class:<{v}:C_X> stbh:<h{u}> cid:<{u}> sid:<{v}> sessMode:<1>",
    "BlackScreen seen on ipvod stream {v}",
    "Video Freeze then enterStandby {u}",
    "epg_set_grid_focus_channel(): Invalid epg handle {v}",
    '"  heartbeat ok {k}, day dream"',
]

_SQL_VALUES = {
    "u": "user_id",
    "v": "CAST(floor(value) AS BIGINT)",
    "d": "(2 * CAST(floor(value) AS BIGINT))",
    "w": "(1000 + user_id % 9000)",
    "k": "event_id",
}


def _pieces(template: str) -> list[str]:
    return [p for p in re.split(r"(\{\w\})", template) if p]


def _sql_concat(template: str) -> str:
    out = []
    for piece in _pieces(template):
        if piece.startswith("{"):
            out.append(f"CAST({_SQL_VALUES[piece[1]]} AS VARCHAR)")
        else:
            out.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(out)


def message() -> Column:
    """The sentence of a row with its numbers put in."""
    v = F.floor("value").cast("bigint")
    values = {"u": F.col("user_id"), "v": v, "d": v * 2, "w": F.col("user_id") % 9000 + 1000, "k": F.col("event_id")}
    text = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


_MESSAGE_SQL = (
    "CASE event_id % " + str(len(MESSAGES)) + " "
    + " ".join(f"WHEN {i} THEN {_sql_concat(t)}" for i, t in enumerate(MESSAGES)) + " END"
)


def _padded() -> Column:
    return F.concat(F.lit("R"), F.lpad(F.col("user_id").cast("string"), 10, "0"))


def logs(spark: SparkSession, sf: str, spread_out: bool = False) -> DataFrame:
    """``logs`` view; ``kind`` is the number of the message sentence."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return log_columns(spread(e) if spread_out else e)


def log_columns(events: DataFrame) -> DataFrame:
    return events.select(
        _padded().alias("rxid"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("category"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"),
        F.concat(F.lit("f"), (F.col("event_id") % 20).cast("string")).alias("directory_file"),
        F.col("event_id").alias("line_no"),
        message().alias("data"),
        F.col("value").alias("metric_num"),
        F.when(F.col("user_id") % 3 == 0, F.lit("good")).otherwise("main").alias("dataset"),
        (F.col("event_id") % len(MESSAGES)).alias("kind"),
        F.floor("value").cast("bigint").alias("v"),
        F.col("user_id").alias("u"),
    )


LOGS_SQL = f"""logs AS (
  SELECT 'R' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS rxid, event_id AS id, ts AS "timestamp",
         event_type AS category, nullif(event_type, 'view') AS event_type,
         'f' || CAST(event_id % 20 AS VARCHAR) AS directory_file, event_id AS line_no,
         {_MESSAGE_SQL} AS data, value AS metric_num,
         CASE WHEN user_id % 3 = 0 THEN 'good' ELSE 'main' END AS dataset,
         event_id % {len(MESSAGES)} AS kind, CAST(floor(value) AS BIGINT) AS v, user_id AS u
  FROM events)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """``lines`` view: (path, line_no, line); the format is event_id % 9.  Every
    50th line carries a broken stamp, and some files start with one."""
    e = spread(spark.read.parquet(f"{sf}/events.parquet"))
    f = F.col("event_id") % 9
    u, k = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    us = F.date_format("ts", "MM/dd/yyyy HH:mm:ss")
    ms = F.date_format("ts", "SSS")
    broken = F.col("event_id") % 50 == 7
    stamp = F.when(broken, F.concat(F.lit("99/99/2024 "), F.date_format("ts", "HH:mm:ss"))).otherwise(us)
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(f == 0, c("[", F.col("event_type"), "]<", stamp, ".", ms, "><src.c:", u, "> run(): val ", k))
        .when(f == 1, c("[", F.col("event_type"), "]<", stamp, "> screen ", u, ", shown ", k))
        .when(f == 2, c("[", F.col("event_type"), "]<", stamp, "> part ", k))
        .when(f == 3, c(stamp, ": DCore", u, " : started ", k))
        .when(f == 4, c(F.date_format("ts", "MMM d HH:mm:ss"), " svc", u, "[", k, "]: up ", k))
        .when(f == 5, c("[x]<", stamp, "> ERR-", u, " | net | dial | no route ", k))
        .when(f == 6, c(us, ":", ms, " raw ", k))
        .when(f == 7, c("[", F.col("event_type"), "]<", us, " -0700> ", k, ":[sub]<p.cpp:", u, "> go(a): a:", u, ", b:", k))
        .otherwise(c(stamp, " plain ", k))
    )
    return e.select(
        c("/logs/", _padded(), "/run", ".log").alias("path"), F.col("event_id").alias("line_no"), text.alias("line")
    )


# what the parser must give back, straight from the events: ``stamp`` is the time
# written on the line, ``ts`` the final one (a broken stamp takes the date before it)
LINES_SQL = """lines AS (
  SELECT *, CASE WHEN broken THEN date_trunc('day', seen) + (sec - date_trunc('day', sec)) ELSE stamp END AS ts_out FROM (
    SELECT *, last_value(CASE WHEN NOT broken THEN stamp END IGNORE NULLS) OVER (
      PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
      SELECT *, CASE WHEN f = 7 THEN sec + INTERVAL 7 HOUR WHEN f IN (0, 6) THEN date_trunc('millisecond', ts) ELSE sec END
          AS stamp, event_id % 50 = 7 AND f NOT IN (4, 6, 7) AS broken FROM (
        SELECT *, event_id % 9 AS f, CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS k,
          '/logs/R' || lpad(CAST(user_id AS VARCHAR), 10, '0') || '/run.log' AS path, date_trunc('second', ts) AS sec
        FROM events))))"""


def with_views(sql: str) -> str:
    """Put the views a statement mentions in front of it."""
    used = [text for name, text in (("logs", LOGS_SQL), ("lines", LINES_SQL)) if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    head = "WITH " + ",\n".join(used)
    body = sql.strip()
    return f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"
