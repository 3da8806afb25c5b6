"""Work that stays spread out, and is done once, however the files and the rows lie."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from boxlore import jobs
from boxlore.operators import classify, parse, topics
from boxlore.sources import files, text_files
from boxlore.sources.tables import spread


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_spread_counts_splits_that_hold_rows(spark, tmp_path):
    """One row group cut into many splits lies in one of them."""
    cores, path, key = spark.sparkContext.defaultParallelism, str(tmp_path / "one"), "spark.sql.files.maxPartitionBytes"
    spark.range(20_000).coalesce(1).write.parquet(path)
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= cores
        rows = spread(df)
        assert rows.groupBy(F.spark_partition_id()).count().count() == cores and rows.agg(F.sum("id")).first()[0] == 199_990_000
    finally:
        spark.conf.set(key, before)


def test_forest_rows_lie_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(classify, "TASK_BYTES", 4 * 10 * 100)
    dealt = classify._dealt(spark.range(1000).coalesce(1), 10)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 110
    few = spark.range(100).coalesce(1)
    assert classify._dealt(few, 10) is few
    empty = spark.range(0)
    assert classify._dealt(empty, 10) is empty


def test_tfidf_shuffles_places_of_kept_terms(spark):
    """Equal ids are one text, null ids too; only terms of the vocabulary are shuffled, by number."""
    df = spark.createDataFrame([(1, "aa bb aa cc"), (1, "bb"), (None, "aa"), (None, "dd aa"), (2, None), (3, "zz")], "id long, text string")
    out = classify.tfidf_terms(df, "id", F.col("text"), 2)
    assert not re.search(r"hashpartitioning\(id#\d+L?, term", _plan(out))
    got = {(r["id"], r["term"]): r["weight"] for r in out.collect()}
    # aa 4 times in 2 texts, bb twice in 1, of 6 rows
    aa, bb = 2 * (math.log(7 / 3) + 1), 2 * (math.log(7 / 2) + 1)
    norm = (aa * aa + bb * bb) ** 0.5
    assert got.keys() == {(1, "aa"), (1, "bb"), (None, "aa")}
    assert abs(got[1, "aa"] - aa / norm) < 1e-12 and abs(got[1, "bb"] - bb / norm) < 1e-12 and got[None, "aa"] == 1.0


def test_coherence_reads_the_texts_once(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["b", "a"],), (None,)], "tokens array<string>")
    out = topics.coherence(df, {0: ["a", "b"], 1: ["a", "x"]})
    assert "array_intersect" not in _plan(out)
    got = {r["topic"]: round(r["coherence"], 6) for r in out.collect()}
    assert got == {0: round(math.log(2 * 4 / (3 * 2)) / -math.log(2 / 4), 6), 1: -1.0}


def test_files_are_dealt_into_folders(spark, tmp_path, monkeypatch):
    """No folder per file; paths sort like names, null lines are empty, null names share a file."""
    monkeypatch.setattr(text_files, "FOLDER_FILES", 10)
    rows = [(f"R{n:010d}", k, None if k == 1 else f"line {n} {k}  ") for n in range(100) for k in (2, 0, 1)] + [(None, 5, "x"), (None, 4, "y")]
    df = spark.createDataFrame(rows, "rxid string, id long, text string")
    assert text_files.write_files(df, "rxid", ["id"], "text", f"file://{tmp_path}/a", "\r\n") == 101
    found = sorted((tmp_path / "a").rglob("*.*"))
    assert [f.name for f in found] == [f"rxid=R{n:010d}.txt" for n in range(100)] + [f"rxid={text_files.NO_NAME}.txt"]
    assert len({f.parent for f in found}) <= 20 and max(Counter(f.parent for f in found).values()) <= 10
    assert found[7].read_bytes() == "line 7 0  \r\n\r\nline 7 2  \r\n".encode() and found[-1].read_bytes() == b"y\r\nx\r\n"
    assert text_files.write_files(df.where("false"), "rxid", ["id"], "text", str(tmp_path / "b")) == 0
    assert files.raw_lines(spark, str(tmp_path / "b")).count() == 0


def test_ingest_reads_the_text_once(spark, tmp_path):
    for n in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"R000000000{n}_nal.log").write_text("".join(f"01/15/2025 05:11:{k:02d} line {n} {k}\n" for k in range(20)))
    read = spark.sparkContext.accumulator(0)

    def counted(value):
        read.add(1)
        return value

    raw = files.raw_lines(spark, str(tmp_path / "in"))
    raw = raw.withColumn("value", F.udf(counted, "string").asNondeterministic()("value"))
    jobs.store_lines(raw, str(tmp_path / "store"), 2025)
    got = spark.read.parquet(str(tmp_path / "store" / "logs"))
    assert got.count() == 60 and {r[0] for r in got.select("source_table").distinct().collect()} == {
        f"R000000000{n}_R000000000{n}_nal" for n in range(3)}
    assert read.value == 60


def test_files_of_one_block_need_no_summaries(spark):
    """Dates are carried into the later blocks of a file; a file of one block carries its own."""
    text = ["no stamp", "01/15/2025 05:11:00 a", "99/99/2024 06:00:00 b", "[x]<99/99/2024 07:00:00> c", "01/16/2025 05:11:00 d", "99/99/2024 08:00:00 e"]
    rows = [(path, k, line, k // size, -(-len(text) // size)) for path, size in (("/a", 6), ("/b", 2), ("/c", 1)) for k, line in enumerate(text)]
    df = spark.createDataFrame(rows, "path string, line_no long, line string, _segment long, _segments long")
    pick = ["path", "line_no", "timestamp", "timestamp_imputed", "data"]
    want = sorted(map(str, parse.parse_lines(df.drop("_segment", "_segments"), 2025).select(*pick).collect()))
    assert sorted(map(str, parse.parse_lines(df, 2025).select(*pick).collect())) == want and len(want) == 15
    assert sorted(map(str, parse.parse_lines(df.drop("_segments"), 2025).select(*pick).collect())) == want
