"""Run registered queries in Spark and their SQL in DuckDB and compare the values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [norm(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([norm(row[i]) for i in order]) for row in rows)


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def compare(spark, con, sf: str, name: str, make, sql: str | None) -> str:
    df = make(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows={len(got)}" if got else "EMPTY"
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    if sorted(columns) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} vs {sorted(columns)}"
    types = {c: str(t[1]) for c, t in zip(columns, want.description)}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    for c, t in df.dtypes:
        if t in kinds and kinds[t] != types[c]:
            return f"DIFF type of {c}: {t} vs {types[c]}"
    a, b = rows_of(df.columns, got), rows_of(columns, want.fetchall())
    if a == b:
        return f"ok rows={len(a)}" if a else "EMPTY"
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"DIFF rows {len(a)} vs {len(b)}\n  spark {only_a}\n  sql   {only_b}"


def main(sf: str, pick: list[str]) -> int:
    import __spark_entry__ as entry
    from boxlore.session import build_session

    from pyspark.sql import SparkSession

    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.driver.memory", "8g").config(
        "spark.ui.showConsoleProgress", "false").getOrCreate()
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = connect(sf), entry.queries(), entry.oracle_sql(), 0
    for name, make in queries.items():
        if pick and not any(p in name for p in pick):
            continue
        start = time.time()
        try:
            result = compare(spark, con, sf, name, make, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - the report goes on
            result = "FAIL " + str(error)[:900]
        bad += not (result.startswith("ok") or result.startswith("rows="))
        print(f"{name:38s} {time.time() - start:6.2f}s {result}", flush=True)
    print(f"{len(queries)} queries, {len(oracles)} with SQL, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
