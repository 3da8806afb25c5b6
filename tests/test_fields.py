"""One literal per message pattern."""

import pytest
from pyspark.sql import functions as F

from boxlore.functions.message_fields import display_drop, extract_fields
from boxlore.operators import enrich

CASES = [
    ("Interface eth0 Not Connected(-1)", {"interface": "eth0", "connection_status": "Not Connected", "interface_status_code": "-1"}),
    ("Interface eth0 Connected", {"interface": "eth0", "connection_status": "Connected", "interface_status_code": None}),
    ("Need to start Auto IP thread for eth0, thread (t1), event -3", {"auto_ip_interface": "eth0", "auto_ip_thread": "t1", "auto_ip_event": "-3"}),
    ("Arping for 10.0.0.1", {"arping_ip": "10.0.0.1"}),
    ("Destin. MAC: aa:bb:cc:dd:ee:ff", {"packet_mac_type": "Destin.", "packet_mac": "aa:bb:cc:dd:ee:ff"}),
    ("Sender IP : 10.0.0.2", {"arp_details_role": "Sender", "arp_details_type": "IP", "arp_details_value": "10.0.0.2"}),
    ("SGS Msg <5:GET> took <12 ms> SGS Return Code:<1:OK> rx_id:<R1-x>", {"sgs_msg_id": "5", "sgs_duration_ms": "12", "sgs_rx_id": "R1-x"}),
    ("MAC Select thread running on <eth1> interface", {"mac_select_interface": "eth1"}),
    ("starting thread:<net thread>, version:<3>", {"worker_thread": "net thread", "worker_thread_version": 3}),
    ("Allocated 10 bytes in 2 chunks. (via mmap)", {"allocated_mmap_bytes": "10", "allocated_mmap_chunks_num": 2}),
    ("Allocated 9 bytes x (via malloc)", {"allocated_malloc_bytes_num": 9, "allocated_mmap_bytes": None}),
    ("svc_name = HBO-HD", {"svc_name": "HBO-HD"}),
    ("VIDEO Resolution: 1920x1080", {"video_resolution": "1920x1080"}),
    ("DUMPING FILE a", {"customer_marked_flag": "YES"}),
    ("Type:<7:ES_STB_MSG_TYPE_EPG_CUR_PROGRAM_ALL> Class:<2:C_X> stbh:<h1> cid:<11> sid:<22> sessMode:<1>",
     {"msg_type_code": 7, "msg_class_name": "C_X", "stbh": "h1", "cid": "11", "sid": "22", "sessMode": "1"}),
    ('  "plain text" ', {"interface": None, "customer_marked_flag": None, "svc_name": None}),
]


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, data string")
    return {r["i"]: r for r in extract_fields(df, fields=[(None, r"(plain) (text)", ["p1", "p2"])]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fields(extracted, i):
    for name, value in CASES[i][1].items():
        assert extracted[i][name] == value, name
    if i == len(CASES) - 1:
        assert (extracted[i]["p1"], extracted[i]["p2"]) == ("plain", "text")
        assert all(extracted[i][c] is None for c in extracted[i].asDict() if c not in ("i", "data", "p1", "p2"))


def test_display_drop(spark):
    df = spark.createDataFrame([("display drop detected = 350",), ("x",)], "d string")
    assert [r[0] for r in df.select(display_drop(F.col("d"))).collect()] == [350, 0]


def test_rules_beat_the_model(spark):
    df = spark.createDataFrame([(1, "DUMPING FILE x", None), (2, "hello", None), (3, "ipll", "a"), (4, "hm", "b")],
                               "id int, data string, event_type string").withColumn("category", F.lit("c"))
    model = lambda rows: rows.withColumn("predicted", F.when(F.col("id") == 2, "guess").otherwise("UNKNOWN"))
    got = {r["id"]: r["event_type"] for r in enrich.enrich(df, model).collect()}
    assert got == {1: "MARKED_LOGS", 2: "guess", 3: "a, signal_protector", 4: "b"}
