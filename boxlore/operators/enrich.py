"""Labels from message text, and the enrichment chain."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from boxlore.functions import fixed_values as fixed
from boxlore.functions.message_fields import FieldSpec, extract_fields, known_event


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def protect_signal(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add the signal label once to the event type of rows that mention a signal word."""
    names = columns or text_columns(df)
    words = "|".join(fixed.PROTECTOR_WORDS)
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(f"`{c}`")).rlike(words), F.lit(False)) for c in names])
    current = F.nullif(F.col("event_type"), F.lit(""))
    has = F.lower(F.col("event_type")).contains(fixed.PROTECTOR_EVENT)
    added = F.when(F.coalesce(has, F.lit(False)), F.col("event_type")).otherwise(
        F.concat_ws(", ", current, F.lit(fixed.PROTECTOR_EVENT))
    )
    return df.withColumn("event_type", F.when(hit, added).otherwise(F.col("event_type")))


def feature_text(columns: list[str], extras: list[str] = fixed.EXTRA_FEATURES) -> Column:
    """Text of the columns, NULLs as empty, then the extra fields that are filled."""
    base = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    filled = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in extras]
    return F.concat_ws(" ", base, *filled)


def label() -> Column:
    """Event type, else category, else UNKNOWN."""
    given = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return F.coalesce(given("event_type"), given("category"), F.lit("UNKNOWN"))


def rule_labels(df: DataFrame, fields: list[FieldSpec] | None = None) -> DataFrame:
    """Message fields, known message types and the mark label."""
    df = extract_fields(df, fields=fields)
    return df.withColumn(
        "event_type",
        F.when(F.col("customer_marked_flag") == "YES", F.lit(fixed.MARKED_EVENT)).otherwise(
            F.coalesce(known_event(F.col("msg_type_name")), F.col("event_type"))
        ),
    )


def enrich(df: DataFrame, predict: Callable[[DataFrame], DataFrame] | None = None,
           fields: list[FieldSpec] | None = None) -> DataFrame:
    """Fields, rule labels, predicted labels for rows still without one, signal label.

    ``predict`` adds a column ``predicted``; UNKNOWN predictions are not written.
    The signal words are looked for in the given columns and the label: the
    fields are pieces of the message, so they hold no word it does not."""
    given = list(dict.fromkeys([*text_columns(df), "event_type"]))
    df = rule_labels(df, fields)
    if predict is not None:
        empty = F.coalesce(F.trim("event_type"), F.lit("")) == ""
        df = predict(df)
        df = df.withColumn(
            "event_type",
            F.when(empty & (F.col("predicted") != "UNKNOWN"), F.col("predicted")).otherwise(F.col("event_type")),
        ).drop("predicted")
    return protect_signal(df, given)
