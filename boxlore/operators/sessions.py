"""Playback sessions cut at marker lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxlore.functions import fixed_values as fixed
from boxlore.functions.message_fields import display_drop, field_columns
from boxlore.functions.text import contains_any
from boxlore.plans.ordered import SEGMENT, ranked_blocks, running_count, time_slice

#: Events per nested list; longer sessions continue in further parts.
EVENTS_PER_PART = 10_000
_LAST_SEGMENT = (1 << 62)


def _text() -> Column:
    return F.trim(F.coalesce("data", F.lit("")))


def number_sessions(df: DataFrame, marker: Column | None = None, keys: list[str] = ["rxid"]) -> DataFrame:
    """Adds ``is_marker`` and ``session_no``; rows before the first marker are session 0.

    Rows without a stamp come last, as in an ascending sort with nulls last."""
    hit = F.lower(_text()).contains(fixed.SESSION_MARKER) if marker is None else F.coalesce(marker, F.lit(False))
    rows = df.withColumn("is_marker", hit).withColumn(
        SEGMENT, F.coalesce(time_slice(F.col("timestamp")), F.lit(_LAST_SEGMENT))
    )
    return running_count(rows, keys, ["timestamp", "id"], F.col("is_marker"), "session_no")


def alert_tests(data: Column, drop: Column) -> dict[str, Column]:
    """Alert name -> does the line count for it; ``drop`` is the reported drop length."""
    lower = F.lower(data)
    tests = {name: lower.contains(word) for name, word in fixed.SESSION_ALERTS.items()}
    dropped = lower.contains(fixed.SESSION_DROP_TEXT)
    for name, low, high in fixed.SESSION_DROP_BUCKETS:
        inside = F.lit(True) if low is None else drop >= low
        tests[name] = dropped & (inside if high is None else inside & (drop < high))
    return tests


def is_other_event(data: Column) -> Column:
    return contains_any(F.lower(data), fixed.SESSION_OTHER)


def session_summary(numbered: DataFrame, keys: list[str] = ["rxid"]) -> DataFrame:
    """One row per session: start, service, resolution and alert tallies (all sums,
    so they fold map-side)."""
    text, body = F.col("_text"), ~F.col("is_marker")
    fields = field_columns(text)
    opened = lambda c: F.max(F.when(F.col("is_marker"), c))
    rows = numbered.withColumn("_text", _text()).withColumn("_drop", display_drop(F.col("_text")))
    return rows.groupBy(*keys, "session_no").agg(
        F.min("timestamp").alias("change_content_timestamp"),
        opened(fields["svc_name"]).alias("svc_name"),
        opened(fields["video_resolution"]).alias("video_resolution"),
        *[F.count_if(body & test).alias(name) for name, test in alert_tests(text, F.col("_drop")).items()],
        F.count_if(body & is_other_event(text)).alias("n_other_events"),
    )


def session_events(numbered: DataFrame, keys: list[str] = ["rxid"]) -> DataFrame:
    """The stand-by and day-dream lines of sessions, one row each."""
    text = _text()
    return numbered.where(~F.col("is_marker") & is_other_event(text)).select(
        *keys, "session_no", "timestamp", "id", text.alias("description")
    )


def session_documents(numbered: DataFrame, keys: list[str] = ["rxid"]) -> DataFrame:
    """Sessions as JSON with nested alerts and ordered events.

    A session with very many events spreads over several ``part`` rows, so no
    list grows without bound and none is cut."""
    alerts = [*fixed.SESSION_ALERTS, *[name for name, _, _ in fixed.SESSION_DROP_BUCKETS]]
    summary = session_summary(numbered, keys)
    events = session_events(numbered, keys).withColumn(
        SEGMENT, F.coalesce(time_slice(F.col("timestamp")), F.lit(_LAST_SEGMENT))
    )
    by = [*keys, "session_no"]
    parts = (
        ranked_blocks(events, by, ["timestamp", "id"], overlap=0, size=EVENTS_PER_PART)
        .groupBy(*by, F.col("_block").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "timestamp", "description"))).alias("_events"))
    )
    joined = summary.join(parts, by, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    other = F.transform(F.coalesce("_events", F.array()), lambda e: F.struct(e["timestamp"], e["description"]))
    body = F.struct(
        "change_content_timestamp", "svc_name", "video_resolution", F.struct(*alerts).alias("alerts"),
        other.alias("other_events"),
    )
    return joined.select(*by, "part", F.to_json(body).alias("analysis_json"))
