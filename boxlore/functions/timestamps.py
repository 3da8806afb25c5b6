"""Stamp text to UTC instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# All ways a date is written, as one pattern whose replacement puts year, month and
# day in ISO order (groups that took no part are empty).  Text of any other shape
# turns into something the cast below refuses.
_DATE = (
    r"^(?:(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})"  # 2025-01-15
    r"|(1[3-9]|2\d|3[01])[/.\-](\d{1,2})[/.\-](\d{4})"  # 15/01/2025
    r"|(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})"  # 01/15/2025
    r"|(\d{1,2})[/\-](\d{1,2})(?=[ T]\d))"  # 01/15 with a time
    r"(?:[ T](\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?))?(?: ?([+-]\d{2}):?(\d{2}))?$|^.*$"
)
_ISO = "$1$6$9-$2$5$7$10-$3$4$8$11 $12$13$14"
_ZONE = r"(\d:\d{1,2}(?:\.\d+)?)([+-]\d{2})(\d{2})$"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_CLOCK_IN_LINE = r"(\d{1,2}):(\d{1,2}):(\d{1,2})"


def iso_text(stamp: Column, reference_year: Column | int) -> Column:
    """Stamp text as ``y-m-d h:m:s[zone]``; the year is filled in where it is missing."""
    text = F.trim(F.regexp_replace(stamp, r"\s+", " "))
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(text, 1, 3)))
    named = F.concat(month.cast("string"), F.regexp_replace(text, "^[A-Za-z]+ ", "/"))
    numeric = F.when(text.rlike(r"^[A-Za-z]{3,9} \d"), named).otherwise(text)
    year = reference_year if isinstance(reference_year, Column) else F.lit(reference_year)
    return F.regexp_replace(F.regexp_replace(numeric, _DATE, _ISO), F.lit("^-"), F.concat(year.cast("string"), F.lit("-")))


def instant(iso: Column) -> Column:
    """ISO text to an instant: naive is UTC, no clock is midnight, impossible is NULL."""
    return F.coalesce(
        F.concat(iso, F.lit("Z")).try_cast("timestamp"),
        F.concat(iso, F.lit("00:00:00Z")).try_cast("timestamp"),
        F.concat(iso, F.lit(":00Z")).try_cast("timestamp"),
        F.when(iso.rlike(_ZONE), F.regexp_replace(iso, _ZONE, "$1$2:$3").try_cast("timestamp")),
    )


def to_utc(stamp: Column, reference_year: Column | int) -> Column:
    """Stamp text to an instant.  A trailing ``-HHMM`` is honoured, stamps without a
    year take ``reference_year``, anything that is no date is NULL."""
    return instant(iso_text(stamp, reference_year))


def clock_micros(line: Column) -> Column:
    """First H:M:S in a line as microseconds of the day; NULL when it is no valid time."""
    hour, minute, second = (F.regexp_extract(line, _CLOCK_IN_LINE, g).try_cast("int") for g in (1, 2, 3))
    valid = (hour < 24) & (minute < 60) & (second < 60)
    return F.when(valid, (hour * 3600 + minute * 60 + second).cast("bigint") * 1_000_000)


def missing_filled(stamp: Column, run_time: Column) -> tuple[Column, Column]:
    """Stamp with the run time where missing, and the flag that says so."""
    return F.coalesce(stamp, run_time), stamp.isNull()


def epoch_seconds(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) / F.lit(1e6)


def in_year_2000(stamp: Column) -> Column:
    """Same instant of the year, moved to 2000 (a leap year, so every date exists)."""
    return F.make_timestamp(
        F.lit(2000), F.month(stamp), F.dayofmonth(stamp), F.hour(stamp), F.minute(stamp),
        F.date_part(F.lit("SECOND"), stamp),
    )

