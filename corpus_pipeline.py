"""From raw documents to packed training sequences.

Each stage takes what the one before kept, whole, and its decisions take effect: rejected
documents go, of equal and of similar documents one stays, repeated passages are cut out
of the texts, and what is left is packed.  Columns beyond those of documents pass through all
stages but packing, which keeps the id and the pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from boxlore.llm import exact_dedup, jaccard_join, packing, quality, substring_dedup
from boxlore.llm.common import table, written
from boxlore.llm.queries import new_index


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, accepts."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.keep_first(docs, new_index(spark))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur more than once; n_chars follows the text."""
    cut = substring_dedup.remove(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each a power of two long."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", accept),
    ("exact dedup", keep_one_of_equal),
    ("near dedup", keep_one_of_similar),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
