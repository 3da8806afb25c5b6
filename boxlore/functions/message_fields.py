"""Fields cut out of message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxlore.functions import fixed_values as fixed
from boxlore.functions.text import contains_any, group_or_null

WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

#: (text every match contains or None, pattern, output column of each group)
FieldSpec = tuple[str | None, str, list[str]]


def field_columns(data: Column, fields: list[FieldSpec] | None = None) -> dict[str, Column]:
    """One nullable column per field; ``fields`` adds user-defined patterns."""
    text = F.btrim(F.btrim(data, F.lit(WHITE_SPACE)), F.lit('"'))
    out: dict[str, Column] = {
        "customer_marked_flag": F.when(contains_any(text, fixed.MARK_TEXTS), F.lit("YES")),
    }
    for gate, pattern, names in fixed.MESSAGE_FIELDS + list(fields or []):
        for group, name in enumerate(names, 1):
            value = group_or_null(text, pattern, group)
            if name in fixed.MESSAGE_CODES:
                value = value.try_cast("bigint")
            where = F.lower(text) if pattern.startswith("(?i)") else text
            out[name] = F.when(where.contains(gate), value) if gate else value
            if name in fixed.MESSAGE_NUMBERS:
                out[f"{name}_num"] = out[name].try_cast("bigint")
    return out


def extract_fields(df: DataFrame, data: str = "data", fields: list[FieldSpec] | None = None,
                   only: list[str] | None = None) -> DataFrame:
    """Add the message fields (or ``only`` some of them) to ``df``."""
    columns = field_columns(F.col(data), fields)
    return df.withColumns({k: v for k, v in columns.items() if only is None or k in only})


def display_drop(data: Column) -> Column:
    """Reported drop length, 0 when there is none."""
    found = F.regexp_extract(data, fixed.DISPLAY_DROP, 1).try_cast("int")
    return F.coalesce(F.when(F.lower(data).contains(fixed.SESSION_DROP_TEXT), found), F.lit(0))


def known_event(msg_type: Column) -> Column:
    """Event type of the message types that have a fixed one."""
    pairs = [F.lit(x) for pair in fixed.KNOWN_EVENTS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), msg_type)


def epg_event(data: Column) -> Column:
    return F.when(F.lower(data).contains(fixed.EPG_TEXT), F.lit(fixed.EPG_EVENT))


def details_map(text: Column) -> Column:
    """``k:v, k:v`` text to a map, both sides trimmed; the last of equal keys stays."""
    items = F.filter(F.split(text, ","), lambda item: item.contains(":"))
    pairs = F.transform(items, lambda item: F.split(item, ":", 2))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    keys = F.transform(entries, lambda e: e["k"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]))
    return F.map_from_entries(last)
