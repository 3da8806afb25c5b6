"""Archives read back record by record and as plain gzip files."""

import gzip
import hashlib

import duckdb

from boxlore.llm import queries, warc
from boxlore.llm.common import written
from tests.llm.helpers import SF, saved


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(pages):
    last = {}
    for key, _, html in pages:
        if len((html or "").encode()) >= 1000 and key is not None:
            last[html] = max(last.get(html, key), key)
    out = []
    for key, _, html in pages:
        body = (html or "").encode()
        to = last.get(html) if key is not None and last.get(html) != key else None
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


HARD = [
    (1, "http://a/\r\nX: y", None), (2, None, ""), (3, "http://a/é b", "é" * 700), (4, "u", "é" * 700), (5, "u", "é" * 700),
    (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "WARC/1.1\r\n\r\n" * 100), (9, "u", "big" * 700_000), (None, "u", "é" * 700),
    (9, "u", "big" * 700_000), (0, "u", "big" * 700_000),
]


def test_hard_pages(spark, tmp_path):
    folder = saved(spark, tmp_path, pages=pages_of(spark, HARD))
    assert sorted(map(tuple, queries.op6_warc(spark, folder).collect()), key=repr) == expected(HARD)


def test_empty(spark, tmp_path):
    assert queries.op6_warc(spark, saved(spark, tmp_path, pages=pages_of(spark, []))).count() == 0


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    assert sorted(map(tuple, queries.op6_warc(spark, SF).collect())) == sorted(con.execute(queries.ORACLES["op6_warc"]).fetchall())


def test_ranges_and_whole_files(spark, tmp_path, monkeypatch):
    """Few of the records, over many archives; and each archive is valid gzip from end to end."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumnRenamed("page_id", "digest").withColumnRenamed("url", "offset")
    folder = f"{tmp_path}/archives"
    index = written(warc.write(warc.decide(pages, "digest", "offset"), folder), "index")
    chosen = index.where("id % 7 = 3")
    got = {r.id: r.payload.decode() for r in warc.read(chosen, folder).collect()}
    want = {r.digest: r.html for r in pages.where("digest % 7 = 3").collect()}
    assert got == want
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").iterdir())
    assert raw.count(b"WARC-Type: ") == pages.count()
