"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of
the longest as fit, then one for each set bit of what is left.  Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding; batches
are made of pieces of one length (its bucket).  After encoding no row is shuffled.

Defined results: null text counts as empty; every document ends with ``end_id``, so an
empty one is a single piece of one token.  Repeated rows are packed each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from boxlore.llm import byte_bpe
from boxlore.llm.common import small_batches

LONGEST = 2048
END = 1


class Tokens:
    """Compiled encoder of the same vocabulary; texts that it can't take are encoded by the trie."""

    def __init__(self, path: str):
        vocabulary = byte_bpe.Vocabulary(path)
        self.path = path
        self.compiled = tiktoken.Encoding(
            "packing", pat_str=byte_bpe.WORDS, mergeable_ranks=vocabulary.ids, special_tokens=vocabulary.special)

    def encode(self, text: str) -> bytes:
        try:
            return self.compiled.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except BaseException as error:  # its pattern matcher panics on huge runs of white space
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return byte_bpe.encoder(self.path).encode(text)


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row, the ids of the whole text as four bytes each."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tokens(vocabulary)
        for batch in small_batches(batches):
            ids = [compiled.encode(value or "") for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    return docs.select(key, text).mapInArrow(work, f"key {kind}, ids binary").withColumnRenamed("key", key)


def cut(encoded: DataFrame, key: str = "doc_id", longest: int = LONGEST) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens) of rows (key, ids), ids being four bytes each."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    n = F.length("ids").cast("long") / 4
    return (
        encoded.select(key, "ids", n.cast("long").alias("doc_tokens"))
        .withColumn("pieces", F.expr(f"""
            concat(
                transform(sequence(0L, greatest(doc_tokens div {longest} - 1, 0L)),
                          k -> struct(k * {longest} AS start, if(doc_tokens >= {longest}, {longest}L, 0L) AS length)),
                transform(reverse(sequence(0, {longest.bit_length() - 2})),
                          j -> struct(doc_tokens - doc_tokens % shiftleft(2L, j) AS start,
                                      doc_tokens & shiftleft(1L, j) AS length)))
        """))
        .withColumn("piece", F.explode(F.filter("pieces", lambda p: p["length"] > 0)))
        .select(
            key, "piece.start", "piece.length", "doc_tokens",
            F.expr("substring(ids, int(piece.start * 4 + 1), int(piece.length * 4))").alias("ids"),
        )
    )


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """Pieces of all documents with their sequence: sequence_id, offset (always 0) and bucket (the length)."""
    end = F.lit(END.to_bytes(4, "little"))
    encoded = encode(docs, vocabulary, key, text).withColumn("ids", F.concat("ids", end))
    return cut(encoded, key, longest).select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, for readers that batch sequences of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)
