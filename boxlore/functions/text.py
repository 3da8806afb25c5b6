"""String columns: regex groups, file and table names, tokens, masks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxlore.functions import fixed_values as fixed

#: Joins regex groups before they are split again.  Lines are cut at this
#: character (it counts as an end of line), so no line contains it.
GROUP_MARK = "\u001e"


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; NULL when nothing matched or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def split_groups(text: Column, pattern: str, groups: int) -> Column:
    """All groups of a whole-line match as one array, running the regex once."""
    joined = GROUP_MARK.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(text, pattern, joined), GROUP_MARK, groups)


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def receiver_of_path(path: Column) -> Column:
    """First receiver id in a path."""
    return F.coalesce(group_or_null(path, f"({fixed.RECEIVER})"), F.lit(fixed.UNKNOWN_RECEIVER))


def receivers_of_name(name: Column) -> tuple[Column, Column]:
    """First and second receiver id in a name, NULL where missing."""
    found = F.regexp_extract_all(name, F.lit(f"({fixed.RECEIVER})"), F.lit(1))
    return F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(2))


def is_receiver(name: Column) -> Column:
    return name.rlike(f"^{fixed.RECEIVER}$")


def _trim_underscore(text: Column) -> Column:
    return F.regexp_replace(text, "^_+|_+$", "")


def log_base_name(name: Column, short: bool = True) -> Column:
    """Log kind from a file name; ``short=False`` leaves out the last two steps."""
    base = F.regexp_replace(name, r"\d{2}:\d{2}:\d{2}", "")
    base = F.regexp_replace(base, r"\d{4}-\d{2}-\d{2}", "")
    base = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    base = F.regexp_replace(base, r"\d+$", "")
    base = _trim_underscore(F.regexp_replace(base, "[^a-zA-Z0-9_]+", "_"))
    if short:
        base = _trim_underscore(F.regexp_replace(base, r"\d+$", ""))
    return base


def schema_and_table(name: Column) -> tuple[Column, Column]:
    """``schema.table`` cut at the first dot; the schema defaults to public."""
    clean = F.btrim(F.trim(name), F.lit('"'))
    parts = F.split(clean, r"\.", 2)
    strip = lambda part: F.btrim(F.trim(part), F.lit('"'))
    dotted = clean.contains(".")
    schema = F.when(dotted, F.coalesce(F.nullif(strip(parts[0]), F.lit("")), F.lit("public"))).otherwise("public")
    table = F.when(dotted, strip(F.try_element_at(parts, F.lit(2)))).otherwise(clean)
    return schema, table


def mask_addresses(text: Column) -> Column:
    """Put a marker word before MAC addresses and a marked copy before IPv4 ones."""
    masked = F.regexp_replace(text, fixed.MAC_ADDRESS, r"MAC_ADDRESS_$1")
    return F.regexp_replace(masked, fixed.IP_ADDRESS, r"IP_ADDRESS_$1 $1")


def label_line(text: Column) -> Column:
    """Spell out the parts of a log line so that they become words."""
    labelled = F.regexp_replace(
        text, fixed.LABELLED_LINE, r"[MODULE] $1 [TIMESTAMP] $2 [FILELINE] $3 [MESSAGE] $4"
    )
    return F.when(text.startswith("[") & text.rlike(fixed.LABELLED_LINE), labelled).otherwise(F.concat(F.lit("[MESSAGE] "), text))


def words(text: Column) -> Column:
    """Lower-case accent-free words of 2 to 15 letters."""
    plain = F.regexp_replace(F.lower(text), r"[\u0300-\u036f]", "")
    plain = F.translate(plain, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    found = F.regexp_extract_all(plain, F.lit(r"[\p{L}_]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w).between(2, 15) & ~w.startswith("_"))


def index_terms(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
