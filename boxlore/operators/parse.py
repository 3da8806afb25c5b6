"""Raw lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boxlore.functions import fixed_values as fixed
from boxlore.functions.message_fields import details_map, epg_event
from boxlore.functions.text import split_groups
from boxlore.functions.timestamps import clock_micros, instant, iso_text, to_utc
from boxlore.operators.extras import packed, pairs_of
from boxlore.plans.ordered import SEGMENT, SEGMENTS, running_count

Rules = dict[str, tuple[str, list[str]]]

#: text columns a line rule can fill; every parser returns the same table
TEXT_COLUMNS = [
    "category", "file_line", "function", "info", "component", "service", "pid", "tid", "error_level", "code", "module",
    "sub_category", "timezone_offset", "channel", "key", "value_str", "software", "model", "data",
]
COLUMNS = [
    "path", "line_no", "pattern", "timestamp", "timestamp_imputed", *TEXT_COLUMNS, "value_num", "details", "extras", "event_type",
]
#: groups of a line rule that are worked up into other columns
WORKED_UP = ["stamp", "stamp_ms", "details_text"]


def _finish(df: DataFrame, keep: list[str]) -> DataFrame:
    types = {"value_num": "double", "details": "map<string,string>", "extras": "variant", "timestamp_imputed": "boolean"}
    for name in COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(types.get(name, "string")))
    return df.select(*COLUMNS, *[c for c in keep if c not in COLUMNS])


def _matched(lines: DataFrame, rules: Rules) -> DataFrame:
    """The first matching rule (``pattern``) and its groups (``_parts``)."""
    line = F.col("line")
    pattern = parts = None
    for name, (regex, columns) in rules.items():
        start = F if pattern is None else pattern
        hit = line.rlike(regex)
        if rules is fixed.LINE_RULES and name in fixed.LINE_GATES:
            first, inner = fixed.LINE_GATES[name]
            hit = line.startswith(first) & line.contains(inner) & hit
        pattern = start.when(hit, F.lit(name))
        start = F if parts is None else parts
        parts = start.when(F.col("pattern") == name, split_groups(line, regex, len(columns)))
    return lines.withColumn("pattern", pattern).withColumn("_parts", parts)


def _group(rules: Rules, column: str) -> Column:
    """The group called ``column`` of whichever rule matched."""
    out = None
    for name, (_, columns) in rules.items():
        if column in columns:
            start = F if out is None else out
            out = start.when(F.col("pattern") == name, F.col("_parts")[columns.index(column)])
    return F.lit(None).cast("string") if out is None else out


def _carry(df: DataFrame) -> DataFrame:
    """Give lines whose stamp could not be read the date of the stamp before them.

    A carried date never changes what later lines carry, so two windows do: the
    last date, then the last stamp.  Lines of a large file come in segments; one
    summary row per segment brings both into the next ones.  The clock of a line counts
    only where its stamp could not be read."""
    segmented = SEGMENT in df.columns
    # with their number among the keys, files of one segment are left out before their lines are read for the summaries
    keys = [c for c in ("path", SEGMENT, SEGMENTS) if c in df.columns]
    before = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    clock = F.when(F.col("_read").isNull(), clock_micros(F.col("line")))
    df = df.withColumn("_date", F.last("_read", True).over(before)).withColumn("_clock", clock)
    on_day = lambda date, clock: F.timestamp_micros(F.unix_micros(F.date_trunc("day", date)) + clock)
    if segmented:
        several = df.where(F.col(SEGMENTS) > 1) if SEGMENTS in df.columns else df
        df = df.join(_segment_ends(several, keys, on_day), keys, "left").withColumn("_date", F.coalesce("_date", "_carried_date"))
    df = df.withColumn("_own", F.coalesce("_read", on_day(F.col("_date"), F.col("_clock"))))
    previous = F.last("_own", True).over(before)
    if segmented:
        previous = F.coalesce(previous, "_carried_stamp")
    return df.withColumn("_previous", previous).withColumns({
        "timestamp": F.coalesce("_own", "_previous"), "timestamp_imputed": F.col("_read").isNull(),
    })


def _segment_ends(df: DataFrame, keys: list[str], on_day) -> DataFrame:
    """Per segment the last date and the last stamp of the segments before it."""
    read, timed = F.col("_read").isNotNull(), F.col("_read").isNotNull() | F.col("_clock").isNotNull()
    ends = df.groupBy(*keys).agg(
        F.max_by("_read", F.when(read, F.col("line_no"))).alias("_end_read"),
        F.max_by(F.struct("_read", "_date", "_clock"), F.when(timed, F.col("line_no"))).alias("_end"),
    )
    before = W.partitionBy("path").orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_carried_date", F.last("_end_read", True).over(before))
    stamp = F.coalesce("_end._read", on_day(F.coalesce("_end._date", "_carried_date"), F.col("_end._clock")))
    ends = ends.withColumn("_stamp", stamp).withColumn("_carried_stamp", F.last("_stamp", True).over(before))
    return ends.select(*keys, "_carried_date", "_carried_stamp")


def parse_lines(lines: DataFrame, reference_year: int, rules: Rules | None = None) -> DataFrame:
    """Apply the line rules; lines that match none or never get a stamp are dropped.

    ``rules`` replaces the built-in ones: name -> (regex, column of each group),
    with ``stamp`` as the column of the time text.  Groups that name no column of the table
    go, like the pairs of the details, into ``extras``."""
    rules = fixed.LINE_RULES if rules is None else rules
    keep = [c for c in lines.columns if c not in ("path", "line_no", "line", SEGMENT, SEGMENTS)]
    df = _matched(lines, rules)
    names = list(dict.fromkeys(c for _, columns in rules.values() for c in columns))
    df = df.withColumns({c: _group(rules, c) for c in names})
    stamp = F.concat_ws(".", "stamp", "stamp_ms") if "stamp_ms" in names else F.col("stamp")
    if "timezone_offset" in names:
        stamp = F.concat_ws(" ", stamp, "timezone_offset")
    df = df.withColumn("_iso", iso_text(stamp, reference_year))
    df = _carry(df.withColumn("_read", F.when(F.col("pattern").isNotNull(), instant(F.col("_iso")))))
    df = df.where(F.col("pattern").isNotNull() & F.col("timestamp").isNotNull())
    if "details_text" in names:
        df = df.withColumn("details", details_map(F.col("details_text"))).withColumn(
            "data", F.coalesce("data", "details_text")
        ).withColumn(
            "file_line",
            F.when(F.col("details_text").isNotNull(), F.concat(F.lit("<"), "file_line", F.lit(">"))).otherwise(
                F.col("file_line")),
        )
    unknown = {c: F.nullif(c, F.lit("")) for c in names if c not in COLUMNS and c not in WORKED_UP and c not in keep}
    if unknown or "details_text" in names:
        df = df.withColumn("extras", packed(pairs_of(F.col("details") if "details_text" in names else None, unknown)))
    return _finish(df.withColumn("event_type", epg_event(F.col("data"))), keep)


def parse_var(lines: DataFrame) -> DataFrame:
    """``stamp pid tid I VAR - channel: key: value`` lines; others are skipped."""
    keep = [c for c in lines.columns if c not in ("path", "line_no", "line", SEGMENT, SEGMENTS)]
    text = lines.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    df = text.where(F.col("line").rlike(fixed.VAR_LINE)).withColumn("_p", split_groups(F.col("line"), fixed.VAR_LINE, 5))
    rest = F.trim(F.col("_p")[4])
    pair = F.split(rest, ":", 2)
    value = F.coalesce(F.trim(F.try_element_at(pair, F.lit(2))), F.lit(""))
    number = value.rlike(r"^[+-]?(\d+|\d+\.\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$")
    df = df.select(
        *[c for c in df.columns if c not in ("_p", "line")],
        F.lit("var").alias("pattern"),
        to_utc(F.col("_p")[0], 1970).alias("timestamp"),
        F.lit(False).alias("timestamp_imputed"),
        F.col("_p")[1].alias("pid"),
        F.col("_p")[2].alias("tid"),
        F.trim(F.col("_p")[3]).alias("channel"),
        F.trim(pair[0]).alias("key"),
        value.alias("value_str"),
        F.when(number, value.try_cast("double")).alias("value_num"),
    )
    return _finish(df.withColumn("data", F.concat_ws(": ", "key", "value_str")), keep)


def trap_blocks(files: DataFrame) -> DataFrame:
    """Whole-file rows cut at the block headers: (path, line_no = headers before the block, data)."""
    blocks = F.transform(F.split("content", fixed.KTRAP_HEADER), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    rest = [c for c in files.columns if c != "content"]
    cut = files.select(*rest, F.posexplode(blocks).alias("line_no", "data")).where("data <> ''")
    return cut.withColumn("line_no", F.col("line_no").cast("bigint"))


def trap_blocks_of_lines(lines: DataFrame) -> DataFrame:
    """The same blocks from the lines of a large file, with the further columns of the file; one block meets in one task."""
    rest = [c for c in lines.columns if c not in ("path", "line_no", "line", SEGMENT, SEGMENTS)]
    header = F.col("line").rlike(fixed.KTRAP_HEADER)
    numbered = running_count(lines, ["path"], ["line_no"], header, "_block").where(~header)
    texts = numbered.groupBy("path", *rest, "_block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("data")
    )
    trimmed = texts.withColumn("data", F.regexp_replace("data", r"^\s+|\s+$", "")).where("data <> ''")
    return trimmed.withColumnRenamed("_block", "line_no")


def parse_trap(blocks: DataFrame) -> DataFrame:
    """Date, software and model from the head of each block; the block is the message.

    The date is the last one at or before the software line."""
    keep = [c for c in blocks.columns if c not in ("path", "line_no", "data")]
    lines = F.transform(F.split("data", fixed.LINE_ENDS), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    df = blocks.withColumn("_lines", lines)
    at = F.array_position(F.transform("_lines", lambda x: x.rlike(fixed.KTRAP_SOFTWARE)), F.lit(True))
    df = df.withColumn("_at", at)
    head = F.when(F.col("_at") > 0, F.slice("_lines", F.lit(1), F.col("_at").cast("int"))).otherwise(F.col("_lines"))
    dates = F.filter(head, lambda x: x.rlike(fixed.KTRAP_DATE))
    date = F.regexp_extract(F.try_element_at(dates, F.lit(-1)), fixed.KTRAP_DATE, 1)
    line = F.try_element_at("_lines", F.nullif(F.col("_at"), F.lit(0)).cast("int"))
    df = df.select(
        "path", "line_no", *keep, "data",
        F.lit("k_trap").alias("pattern"),
        F.lit("k_trap").alias("category"),
        to_utc(date, 1970).alias("timestamp"),
        F.lit(False).alias("timestamp_imputed"),
        F.regexp_extract(line, fixed.KTRAP_SOFTWARE, 1).alias("software"),
        F.regexp_extract(line, fixed.KTRAP_SOFTWARE, 2).alias("model"),
    )
    return _finish(df, keep)


def file_format(first_line: Column, name: Column) -> Column:
    """var, trap or lines, from the first line and the name of a file."""
    first = F.regexp_replace(first_line, r"^\s+", "")
    return (
        F.when(first.rlike(fixed.VAR_FIRST_LINE), F.lit("var"))
        .when(F.lower(name).contains(fixed.KTRAP_NAME), F.lit("trap"))
        .otherwise(F.lit("lines"))
    )


def topic_line(line: Column, log_type: str) -> tuple[Column, Column]:
    """(component, message) of a line in the topic-model formats; NULLs without a match."""
    regex, component, text = fixed.TOPIC_LINES.get(log_type, fixed.TOPIC_LINES["default"])
    hit = line.rlike(regex)
    message = F.when(hit, F.regexp_replace(F.regexp_extract(line, regex, text), r"^\s+|\s+$", ""))
    found = F.when(hit, F.regexp_extract(line, regex, component)) if component else F.lit(None).cast("string")
    return found, message
