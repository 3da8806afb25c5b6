"""Literal lines of every format."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from boxlore.functions import text
from boxlore.functions.message_fields import details_map
from boxlore.functions.timestamps import to_utc
from boxlore.operators import parse


def lines(spark, rows, path="/logs/R0000000001/a.log"):
    return spark.createDataFrame([(path, i, r) for i, r in enumerate(rows)], "path string, line_no bigint, line string")


def utc(*args):
    return dt.datetime(*args)


CASES = {
    "[nal]<01/15/2025 05:11:30.123><a.c:42> fn(): hello: world": (
        "standard_log", utc(2025, 1, 15, 5, 11, 30, 123000),
        {"category": "nal", "file_line": "a.c:42", "function": "fn()", "data": "hello: world"}),
    "[ui]<01/15/2025 05:11:30> screen, opened": (
        "qt_ui", utc(2025, 1, 15, 5, 11, 30), {"info": "screen", "data": "opened"}),
    "[ui]<01/15/2025 05:11:30> opened": ("qt_ui_chunks", utc(2025, 1, 15, 5, 11, 30), {"data": "opened"}),
    "[x]<01/15/2025 05:11:30> ERR-17 | net | dial | no route": (
        "sbsdk_logs", utc(2025, 1, 15, 5, 11, 30),
        {"error_level": "ERR", "code": "17", "module": "net", "function": "dial", "data": "no route", "category": None}),
    "01/15/2025 05:11:30: DCore : started": (
        "invidi_debug", utc(2025, 1, 15, 5, 11, 30), {"component": "DCore", "data": "started"}),
    "Jan 15 05:11:30 svc[77]: up": ("wjap_logs", utc(2025, 1, 15, 5, 11, 30), {"service": "svc", "pid": "77", "data": "up"}),
    "01/15/2025 05:11:30:123 x": (
        "timestamp_colon_ms", utc(2025, 1, 15, 5, 11, 30, 123000), {"data": "01/15/2025 05:11:30:123 x"}),
    "01/15/2025 05:11:30 x": ("generic", utc(2025, 1, 15, 5, 11, 30), {"data": "x"}),
    "2025-01-15 05:11:30 text": ("generic", utc(2025, 1, 15, 5, 11, 30), {"data": "text"}),
    "01/15 05:11:30 text": ("generic", utc(2025, 1, 15, 5, 11, 30), {"data": "text"}),
    "[pc]<01/15/2025 05:11:30 -0700> 12:[sub]<p.cpp:9> run(a): k1:v1, k2:v2": (
        "pipeline_control", utc(2025, 1, 15, 12, 11, 30),
        {"category": "pc", "pid": "12", "sub_category": "sub", "file_line": "<p.cpp:9>", "function": "run",
         "details": {"k1": "v1", "k2": "v2"}}),
}


@pytest.mark.parametrize("line", list(CASES))
def test_line_formats(spark, line):
    pattern, stamp, fields = CASES[line]
    row = parse.parse_lines(lines(spark, [line]), 2025).first()
    assert row["pattern"] == pattern
    assert row["timestamp"] == stamp
    for name, value in fields.items():
        assert row[name] == value, name


@pytest.mark.parametrize("segmented", [False, True])
def test_carried_stamps(spark, segmented):
    df = lines(spark, [
        "[ui]<99/99> too early", "free text", "2025-01-15 05:11:30 a", "[ui]<99/99 06:00:00> x", "[ui]<99/99 77:77:77> y",
        "[ui]<99/99> z", "2025-01-16 01:00:00 b", "[ui]<99/99 02:00:00> c",
    ])
    if segmented:
        df = df.withColumn("_segment", F.floor(F.col("line_no") / 2))
    got = {r["line_no"]: r["timestamp"] for r in parse.parse_lines(df, 2025).collect()}
    assert got == {
        2: utc(2025, 1, 15, 5, 11, 30), 3: utc(2025, 1, 15, 6), 4: utc(2025, 1, 15, 6), 5: utc(2025, 1, 15, 6),
        6: utc(2025, 1, 16, 1), 7: utc(2025, 1, 16, 2),
    }


def test_event_tag(spark):
    line = "[nal]<01/15/2025 05:11:30><a.c:1> fn: epg_set_grid_focus_channel(): Invalid epg handle 3"
    row = parse.parse_lines(lines(spark, [line]), 2025).first()
    assert row["event_type"] is None or row["event_type"] == "epg_handle_issue"
    line = "[ui]<01/15/2025 05:11:30> epg_set_grid_focus_channel(): Invalid epg handle 3"
    assert parse.parse_lines(lines(spark, [line]), 2025).first()["event_type"] == "epg_handle_issue"


def test_custom_rules(spark):
    rules = {"mine": (r"^(\S+ \S+)#(.*)$", ["stamp", "data"])}
    row = parse.parse_lines(lines(spark, ["2025-01-01 00:00:01#hey", "2025-01-01 00:00:02 no"]), 2025, rules).collect()
    assert [(r["pattern"], r["data"]) for r in row] == [("mine", "hey")]


STAMPS = {
    "15/01/2025 05:11:30": utc(2025, 1, 15, 5, 11, 30), "2025/01/15 05:11:30": utc(2025, 1, 15, 5, 11, 30),
    "2025.01.15 05:11:30": utc(2025, 1, 15, 5, 11, 30), "01-15 05:11:30.5": utc(2025, 1, 15, 5, 11, 30, 500000),
    "January 15 05:11:30": utc(2025, 1, 15, 5, 11, 30), "1/5/2025 5:11:30": utc(2025, 1, 5, 5, 11, 30),
    "2025-01-15T05:11:30.123456": utc(2025, 1, 15, 5, 11, 30, 123456), "2025-01-15": utc(2025, 1, 15),
    "01/15/2025 05:11": utc(2025, 1, 15, 5, 11), "2025-01-15 05:11:30+02:00": utc(2025, 1, 15, 3, 11, 30),
    "02/30/2025 05:11:30": None, "02/29 05:11:30": None, "12:30:01": None, "99/99/2025 01:00:00": None, "": None,
    "Foo 15 05:11:30": None, "hello": None,
}


def test_stamps(spark):
    df = spark.createDataFrame([(s,) for s in STAMPS], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", to_utc(F.col("s"), 2025).alias("t")).collect()}
    assert got == STAMPS


VAR = """
2023-11-02 07:05:09.041  212 9 I VAR - tuner.3: lock count: 12
2023-11-02 07:05:09.120  212 9 I VAR - audio: gain: -3.25
2023-11-02 07:05:10.500  212 11 I VAR - audio: codec: ac3 / 5.1
something else
2023-11-02 07:05:11.007  88 4 I VAR - net_0: link reset:
2023-11-02 07:05:11.007  88 4 I VAR - net_0: mark: 2.0f
"""


def test_var(spark):
    got = parse.parse_var(lines(spark, VAR.split("\n"))).orderBy("line_no").collect()
    assert [(r["channel"], r["key"], r["value_str"], r["value_num"]) for r in got] == [
        ("tuner.3", "lock count", "12", 12.0), ("audio", "gain", "-3.25", -3.25), ("audio", "codec", "ac3 / 5.1", None),
        ("net_0", "link reset", "", None), ("net_0", "mark", "2.0f", None),
    ]
    assert got[0]["timestamp"] == utc(2023, 11, 2, 7, 5, 9, 41000)
    assert (got[0]["pid"], got[3]["tid"]) == ("212", "4")


TRAP = """lead-in
-- TIME Received --
----------------- 02/29/2020 23:59:58 ---------------
----- Software: build-77.x -- Model: Box Nine ------------------------
first of two
second of two
-- TIME Received --
nothing dated
"""


@pytest.mark.parametrize("by_lines", [False, True])
def test_trap(spark, by_lines):
    from boxlore.sources.files import lines_of_files

    files = spark.createDataFrame([("/a/k_trap.log", TRAP)], "path string, content string")
    if by_lines:
        blocks = parse.trap_blocks_of_lines(lines_of_files(files).withColumn("_segment", F.floor(F.col("line_no") / 3)))
    else:
        blocks = parse.trap_blocks(files)
    got = parse.parse_trap(blocks).orderBy("line_no").collect()
    assert [(r["timestamp"], r["software"], r["model"]) for r in got] == [
        (None, None, None), (utc(2020, 2, 29, 23, 59, 58), "build-77.x", "Box Nine"), (None, None, None)]
    assert got[1]["data"].endswith("second of two") and got[0]["data"] == "lead-in"


def test_names(spark):
    df = spark.createDataFrame([("nal_12:30:01_2024-01-05.log.3",), ("stb ctrl--99.log",), (".hidden",)], "n string")
    got = [r[0] for r in df.select(text.log_base_name(F.col("n"))).collect()]
    assert got == ["nal___log", "stb_ctrl", "hidden"]


def test_details_map(spark):
    df = spark.createDataFrame([("a:1, b : x:y ,a:2, junk",)], "t string")
    assert df.select(details_map(F.col("t"))).first()[0] == {"b": "x:y", "a": "2"}
