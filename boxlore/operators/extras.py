"""Fields that the log table has no column for.

Pairs of a line's details and groups of a custom rule that name no column of the table are
kept in one VARIANT column, ``extras``.  A pass over it counts the keys and merges the types
of their values; keys that a share of the rows hold are promoted: later batches get a typed
column for them, which scans read without the rest, and rows stored before still answer
from ``extras``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxlore.sources.tables import new_column_type, read_latest, write_next

#: a key gets a column when at least this share of the rows that have extras hold it
SHARE = 0.01
#: types of merged values that a column can have; others become text
TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}


def packed(pairs: Column) -> Column:
    """A map of texts as VARIANT; whole numbers and truth values keep their type, NULL and empty maps give NULL."""
    quoted = lambda text: F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    plain = lambda text: text.rlike(r"^(-?[1-9]\d{0,17}|0|true|false)$")
    entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(plain(e["value"]), e["value"]).otherwise(quoted(e["value"])))
    kept = F.filter(F.map_entries(pairs), lambda e: e["value"].isNotNull())
    text = F.concat(F.lit("{"), F.array_join(F.transform(kept, entry), ","), F.lit("}"))
    return F.when(F.size(kept) > 0, F.parse_json(text))


def pairs_of(details: Column | None, others: dict[str, Column]) -> Column:
    """Details and other named texts as one map; of equal names the detail stays."""
    empty = F.lit(None).cast("map<string,string>")
    named = [F.create_map(F.lit(name), value.cast("string")) for name, value in others.items()]
    out = F.coalesce(details if details is not None else empty, F.create_map().cast("map<string,string>"))
    for one in named:
        key = F.map_keys(one)[0]
        out = F.when(F.map_contains_key(out, key), out).otherwise(F.map_concat(out, one))
    return out


def key_counts(df: DataFrame) -> DataFrame:
    """(key, rows, kind) of all keys of ``extras``: how many rows hold a key, and the merged type of its values."""
    pairs = df.where("extras IS NOT NULL").select("extras").lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("extras").outer()).select("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("rows"), F.schema_of_variant_agg("value").alias("kind"))


def column_name(key: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", key.lower()).strip("_")


def frequent_keys(df: DataFrame, share: float = SHARE) -> list[tuple[str, str, str]]:
    """(key, column, type) of the keys to promote.  At most 1 / ``share`` keys for each pair a row
    has on average come to the driver.  Of keys that spell the same column the most frequent
    goes first, the others stay in ``extras``, like keys that spell none or hold a quote."""
    held = df.where("extras IS NOT NULL").count()
    counts = key_counts(df).where((F.col("rows") >= share * held) & ~F.col("key").contains("'") & ~F.col("key").contains("\\"))
    out: dict[str, tuple[str, str, str]] = {}
    for row in counts.orderBy(F.desc("rows"), "key").collect():
        name = column_name(row.key)
        if name and name not in out and not name[0].isdigit():
            kind = "bigint" if new_column_type(name) == "bigint" else TYPES.get(row.kind, "string")
            out[name] = (row.key, name, kind)
    return list(out.values())


def value_of(key: str, kind: str, extras: str = "extras") -> Column:
    """A key of ``extras`` as a typed value; NULL where it is missing or of another type."""
    return F.try_variant_get(F.col(extras), f"$['{key}']", kind)


def promoted(df: DataFrame, keys: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` with a column for each key.  A column that is there, whatever its case, is filled where it is NULL."""
    present = {c.lower(): c for c in df.columns}
    types = dict(df.dtypes)
    added = {}
    for key, name, kind in keys:
        if name not in present:
            added[name] = value_of(key, kind)
        elif types[present[name]] == kind:
            added[present[name]] = F.coalesce(F.col(f"`{present[name]}`"), value_of(key, kind))
    return df.withColumns(added) if added else df


# --- the list of promoted keys, beside the table ---------------------------------------------


def read_promoted(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    found = read_latest(spark, path)
    return [] if found is None else [tuple(row) for row in found.select("key", "name", "kind").orderBy("name").collect()]


def note_promoted(spark: SparkSession, path: str, found: list[tuple[str, str, str]]) -> None:
    """Add keys to the list; a column keeps the key and type it was given first."""
    known = read_promoted(spark, path)
    names = {name for _, name, _ in known}
    new = [entry for entry in found if entry[1] not in names]
    if new:
        write_next(spark.createDataFrame(known + new, "key string, name string, kind string"), path)
