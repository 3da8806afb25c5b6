"""Unknown fields: kept as VARIANT, counted, promoted to typed columns."""

import json

import pytest
from pyspark.sql import functions as F

from boxlore import jobs
from boxlore.functions import fixed_values as fixed
from boxlore.operators import extras, parse


@pytest.fixture()
def rows(spark):
    maps = [
        {"a": "7", "b": 'x"y] [\\ \n', "Né w": "true", "n": None}, {"a": "007", "it's": "1"}, None, {}, {"a": "5", "c_num": "12", "A": "x", "9": "1"},
    ]
    return spark.createDataFrame(list(enumerate(maps)), "id int, m map<string,string>").withColumn("extras", extras.packed(F.col("m")))


def test_values_keep_their_text(rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    back = rows.sparkSession.read.parquet(str(tmp_path / "t"))
    got = {r["id"]: r["t"] and json.loads(r["t"]) for r in back.select("id", F.to_json("extras").alias("t")).collect()}
    assert got == {
        0: {"a": 7, "b": 'x"y] [\\ \n', "Né w": True}, 1: {"a": "007", "it's": 1}, 2: None, 3: None, 4: {"a": 5, "c_num": 12, "A": "x", "9": 1}}


def test_keys_become_columns(rows):
    found = {name: (key, kind) for key, name, kind in extras.frequent_keys(rows, 0.3)}
    # the rarer key of the same column, a key with a quote and one that starts with a digit stay behind
    assert found == {"a": ("a", "string"), "b": ("b", "string"), "n_w": ("Né w", "boolean"), "c_num": ("c_num", "bigint")}
    assert {key for key, _, _ in extras.frequent_keys(rows, 0.9)} == {"a"}
    keys = [(key, name, kind) for name, (key, kind) in found.items()]
    got = {r["id"]: r for r in extras.promoted(rows.withColumn("B", F.lit(None).cast("string")), keys).collect()}
    assert [got[k]["a"] for k in range(5)] == ["7", "007", None, None, "5"]
    assert got[0]["B"].startswith("x") and got[0]["n_w"] is True and got[4]["c_num"] == 12 and "b" not in rows.columns


def test_list_keeps_first_type(spark, tmp_path):
    path = str(tmp_path / "keys")
    assert extras.read_promoted(spark, path) == []
    extras.note_promoted(spark, path, [("a", "a", "bigint")])
    extras.note_promoted(spark, path, [("A", "a", "string"), ("b", "b", "string")])
    assert extras.read_promoted(spark, path) == [("a", "a", "bigint"), ("b", "b", "string")]


def test_custom_rule_groups_are_kept(spark):
    rules = {"own": (r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (\w+) rssi=(-?\d+) (.*)$", ["stamp", "service", "rssi", "data"]), **fixed.LINE_RULES}
    lines = spark.createDataFrame([("/x", 0, "2025-01-15 05:11:30 tuner rssi=-61 low"), ("/x", 1, "2025-01-15 05:11:31 plain")], "path string, line_no long, line string")
    got = {r["line_no"]: r for r in parse.parse_lines(lines, 2025, rules).withColumn("extras", F.to_json("extras")).collect()}
    assert got[0]["service"] == "tuner" and json.loads(got[0]["extras"]) == {"rssi": -61} and got[1]["extras"] is None


def test_ingest_promotes_between_batches(spark, tmp_path):
    line = "[cat]<01/15/2025 05:11:{s:02d} -0700> 12:[sub]<p.cpp:7> go(a): level:{s}, mode:m{s}\n"
    for n in range(2):
        folder = tmp_path / f"in{n}" / "R0000000001"
        folder.mkdir(parents=True)
        (folder / "ctl.log").write_text("".join(line.format(s=20 * n + k) for k in range(5)))
        jobs.ingest(spark, str(tmp_path / f"in{n}"), str(tmp_path / "store"), 2025, groups=1)
    stored = jobs.read_stored(spark, str(tmp_path / "store"))
    assert dict(stored.dtypes)["level"] == "bigint"
    got = sorted((r["data"], r["level"], r["own"]) for r in stored.withColumn("own", extras.value_of("level", "bigint")).collect())
    assert sorted(own for _, _, own in got) == [0, 1, 2, 3, 4, 20, 21, 22, 23, 24] and sum(level is not None for _, level, _ in got) == 5
    plan = stored.where("level > 21").select("level")._jdf.queryExecution().toString()
    assert "GreaterThan(level,21)" in plan and "extras" not in plan.split("ReadSchema")[-1]
