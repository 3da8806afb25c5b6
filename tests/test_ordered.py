"""Order-dependent operators against plain Python loops, with one very busy receiver."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boxlore.operators import anomaly, gather, report, sessions, significance
from boxlore.plans.groups import dense_codes, first_per_key, top_per_group
from boxlore.plans.median import exact_median
from boxlore.plans.ordered import SEGMENT, ranked_blocks, sum_around, time_slice

START = dt.datetime(2024, 1, 1)
SCHEMA = "rxid string, id bigint, timestamp timestamp, data string, customer_marked_flag string"


def random_rows(n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rxid = "R0000000001" if rng.random() < 0.5 else f"R{rng.randrange(2, 6):010d}"
        stamp = None if rng.random() < 0.03 else START + dt.timedelta(seconds=rng.randrange(0, 4000))
        text = rng.choice(["CHANGE_CONTENT svc_name=a", "BlackScreen", "Display Drop Detected = 120", "day dream", "x", "yy" * rng.randrange(9)])
        rows.append((rxid, i, stamp, text, "YES" if rng.random() < 0.1 else None))
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_rows()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_receiver(rows, timed=False):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or START, r[1])):
        if r[2] is not None or not timed:
            out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("slice_seconds", [7, 60, 5000])
def test_sum_around(df, rows, slice_seconds):
    out = sum_around(df, ["rxid"], "timestamp", F.when(F.col("customer_marked_flag") == "YES", 1).otherwise(0), 60, "n", slice_seconds)
    got = {r["id"]: r["n"] for r in out.collect()}
    for r in rows:
        want = 0 if r[2] is None else sum(
            1 for o in rows if o[0] == r[0] and o[4] and o[2] and abs((o[2] - r[2]).total_seconds()) <= 60)
        assert got[r[1]] == want
    assert len(got) == len(rows)


def test_boost_edges(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    data = [("R1", 1, at(0), "", "YES"), ("R1", 2, at(60), "", None), ("R1", 3, at(61), "", None), ("R1", 4, at(30), "", "YES"),
            ("R1", 5, None, "", "YES"), ("R2", 6, at(0), "", None)]
    got = {r["id"]: (r["significance_score"], r["important_investigate"])
           for r in significance.boost_marked(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {1: (10.0, True), 2: (10.0, True), 3: (5.0, True), 4: (10.0, True), 5: (None, None), 6: (None, None)}


def test_blocks_hold_their_history(df, rows):
    blocks = ranked_blocks(df.where("timestamp IS NOT NULL").withColumn(SEGMENT, time_slice(F.col("timestamp"), 50)),
                           ["rxid"], ["timestamp", "id"], overlap=4, size=10)
    got = blocks.collect()
    own = {(r["rxid"], r["_rank"]): r["id"] for r in got if not r["_copy"]}
    for rxid, ordered in by_receiver(rows, True).items():
        assert [own[rxid, i + 1] for i in range(len(ordered))] == [r[1] for r in ordered]
    members = {}
    for r in got:
        members.setdefault((r["rxid"], r["_block"]), set()).add(r["_rank"])
    for (rxid, block), ranks in members.items():
        assert len(ranks) <= 14
        mine = [k for k in ranks if (k - 1) // 10 == block]
        if mine and block > 0:
            assert set(range(block * 10 - 3, block * 10 + 1)) <= ranks


def test_sessions(df, rows):
    numbered = sessions.number_sessions(df)
    got = {r["id"]: r["session_no"] for r in numbered.collect()}
    tallies = {(r["rxid"], r["session_no"]): r for r in sessions.session_summary(numbered).collect()}
    for rxid, ordered in by_receiver(rows).items():
        number, black = 0, {}
        for r in ordered:
            if "CHANGE_CONTENT" in r[3]:
                number += 1
            assert got[r[1]] == number
            black[number] = black.get(number, 0) + (r[3] == "BlackScreen")
        for number, n in black.items():
            assert tallies[rxid, number]["BlackScreen"] == n


def test_session_drop_buckets(spark):
    drops = [0, 99, 100, 299, 300, 499, 500, 699, 700]
    data = [("R1", i, START, f"Display Drop Detected = {d}", None) for i, d in enumerate(drops)]
    row = sessions.session_summary(sessions.number_sessions(spark.createDataFrame(data, SCHEMA))).first()
    assert [row[f"DisplayDrop_{b}"] for b in ("0_99", "100_299", "300_499", "500_699", "700_plus")] == [2, 2, 2, 2, 1]
    assert row["session_no"] == 0 and row["svc_name"] is None


def test_session_documents_split_but_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(sessions, "EVENTS_PER_PART", 4)
    data = [("R1", i, START + dt.timedelta(seconds=i), "day dream", None) for i in range(10)]
    out = sessions.session_documents(sessions.number_sessions(spark.createDataFrame(data, SCHEMA))).collect()
    assert sorted(r["part"] for r in out) == [0, 1, 2]
    assert sum(r["analysis_json"].count("day dream") for r in out) == 10


def test_sequences(spark):
    data = [("R1", i, START + dt.timedelta(seconds=i), "a", None) for i in range(16)]
    data += [("R2", 100 + i, START + dt.timedelta(seconds=i), "a", None) for i in range(15)]
    got = anomaly.score_sequences(spark.createDataFrame(data, SCHEMA)).collect()
    assert [(r["id"], r["seq_is_anomaly"], r["seq_issue"]) for r in got] == [(15, False, "normal")]


def test_sequence_scores_do_not_depend_on_materializing(df):
    one = {r["id"]: round(r["seq_score"], 9) for r in anomaly.score_sequences(df).collect()}
    two = {r["id"]: round(r["seq_score"], 9) for r in anomaly.score_sequences(df, materialize=True).collect()}
    assert one == two and len(one) > 1000


def test_wide_rows_score_higher(spark):
    rng = random.Random(0)
    data = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(1000)]
    data += [(1000 + i, [rng.gauss(0, 5) for _ in range(20)]) for i in range(50)]
    names = [f"c{j}" for j in range(20)]
    rows = spark.createDataFrame([(i, *v) for i, v in data], ["id", *names])
    z = anomaly.standardize(rows, {c: f"z{c}" for c in names}, [])
    model = anomaly.fit_reconstruction(z, [f"z{c}" for c in names], 4)
    out = anomaly.score_reconstruction(model, z).groupBy(F.col("id") >= 1000).agg(F.avg("recon_score").alias("s")).collect()
    score = {r[0]: r["s"] for r in out}
    assert score[True] > 2 * score[False]


def test_significance_cases(spark):
    data = [("R1", 1, 0, 1.0), ("R1", 2, 10, None), ("R1", 3, None, None), ("R2", 4, 7, 2.0)]
    got = {r["id"]: r["significance_score"] for r in significance.significance(
        spark.createDataFrame(data, "rxid string, id int, a bigint, b double")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None, 4: 0.0}


def test_gather_reads_the_schema(spark):
    a = spark.createDataFrame([(1, True, "YES", None), (2, None, "", None), (3, False, None, None), (4, False, None, 0.5)],
                              "id int, x_is_anomaly boolean, customer_marked_flag string, a_score double")
    b = spark.createDataFrame([(5, "true"), (6, "")], "id int, important_investigate string")
    c = spark.createDataFrame([(7,)], "id int")
    out = gather.gather_tables({"A": a, "B": b, "C": c}).collect()
    assert sorted((r["table_name"], r["id"]) for r in out) == [("A", 1), ("A", 4), ("B", 5)]


def test_groups_and_codes(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None)], "k string, o int, v string")
    assert sorted((r["k"], r["v"]) for r in first_per_key(df, ["k"], ["o"]).collect()) == [("a", "y"), ("b", None)]
    many = spark.range(2000).select(F.lit("k").alias("k"), F.col("id"))
    assert sorted(r["id"] for r in top_per_group(many, ["k"], [F.desc("id")], 5).collect()) == list(range(1995, 2000))
    names = spark.createDataFrame([(f"R{i:05d}",) for i in range(0, 300, 3)] + [("A",), ("A",)], "s string")
    got = {r["s"]: r["code"] for r in dense_codes(names, "s", prefix=4).collect()}
    assert [got[k] for k in sorted(got)] == list(range(len(got)))


@pytest.mark.parametrize("values", [[5], [1, 2], [10**12, 7, 7, 7], list(range(0, 10**7, 99991)), [-5, -4_000_000_000, 3]])
def test_median(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    assert exact_median(df, F.col("v")).first()[0] == statistics.median(values)


def test_colours(spark):
    data = [("EPG Handle", None, True, True), ("x", "a, signal_protector", None, None), ("x", None, True, True),
            ("x", None, True, None), ("x", None, None, True), (None, None, None, None)]
    df = spark.createDataFrame(data, "message string, event_type string, recon_is_anomaly boolean, seq_is_anomaly boolean")
    assert [r[0] for r in df.select(report.colour()).collect()] == ["green", "yellow", "black", "red", "orange", "blue"]
