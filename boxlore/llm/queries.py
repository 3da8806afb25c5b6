"""Queries of this package, and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from boxlore.llm import (
    byte_bpe, exact_dedup, hard_negatives, html_text, jaccard_join, max_score, near_vectors, packing, quality, ranked_search, substring_dedup,
    token_counts, warc,
)
from boxlore.llm.common import scratch, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL for the same rows where there is some."""

    def register(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return register


def new_index(spark: SparkSession) -> str:
    """An empty digest index of its own, so that a query's result depends on its input alone."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return exact_dedup.open_index(spark, name, scratch(spark, name))


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), new_index(spark))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def byte_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), byte_vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), byte_vocabulary())
    decoded = byte_bpe.decode(encoded.withColumn("ids_sha256", F.sha2("ids", 256)), byte_vocabulary())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted")
    )


@query("""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
    FROM q
""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    index = written(warc.write(warc.decide(table(spark, sf_dir, "pages")), folder), "archive-index")
    records = warc.read(index, folder)
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes",
        F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )


@query()
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query()
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summarize(table(spark, sf_dir, "documents"))


@query()
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("""
    WITH v AS (
        SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20
""")
def op11_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = max_score.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("""
    WITH v AS (
        SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e,
               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
        FROM v a JOIN v c ON len(a.e) = len(c.e) AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT * FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS place
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


@query(r"""
    WITH cut AS (
        SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, lower(upper) AS lower, '[^\x00-/:-@\[-`{-\x7F]+' AS term),
    d AS (SELECT doc_id, regexp_extract_all(translate(text, cut.upper, cut.lower), cut.term) AS terms FROM documents, cut),
    i AS (
        SELECT item_id, term, count(*) AS repeats
        FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, cut.upper, cut.lower), cut.term)) AS term FROM benchmark, cut)
        GROUP BY ALL),
    total AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
    tf AS (
        SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
        WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
    c AS (
        SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS value
        FROM tf JOIN w USING (term), total),
    s AS (SELECT item_id, doc_id, CAST(sum(repeats * value) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY ALL HAVING score > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s)
    SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 20
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
