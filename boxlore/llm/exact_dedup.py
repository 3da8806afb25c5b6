"""Exact de-duplication against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest.  A batch
is folded to one row per digest, what the index lacks is found by a sort-merge
anti-join that shuffles only the batch, and is appended.  DataFrame code only.

Defined results: null text counts as empty; a text that the index knows from an
earlier batch keeps that batch's id; of equal new texts the row with the largest id
stays (null ids are smaller than any); of rows that repeat id and text one stays;
an empty table gives an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxlore.llm.common import written

BUCKETS = 64
#: the largest groups are joined by broadcast; all others have at most 1/65 of the rows
LARGEST = 64


def open_index(spark: SparkSession, name: str, path: str) -> str:
    """The index at ``path`` as table ``name``; made there if it doesn't exist yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {BUCKETS} BUCKETS LOCATION '{path}'"
    )
    return name


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, digest): the SHA-256 of the whole text; ``row`` tells repeated rows apart."""
    return docs.select(
        F.col(key).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
    )


def append_new(rows: DataFrame, index: str) -> DataFrame:
    """Append the digests that the index lacks; one row per digest of the batch is returned.

    Result: digest, group_size, last (id and row of the batch's last row), keep_id, new.
    """
    spark = rows.sparkSession
    groups = written(
        rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("last")), "groups"
    )
    new = groups.hint("merge").join(spark.table(index).hint("merge"), "digest", "left_anti")
    marked = written(new.select("digest"), "new-digests")
    (
        new.select("digest", F.col("last.id").alias("keep_id"))
        .repartition(BUCKETS, "digest")
        .write.mode("append").format("parquet").bucketBy(BUCKETS, "digest").sortBy("digest").saveAsTable(index)
    )
    known = spark.table(index).hint("merge")
    return groups.join(known, "digest").join(marked.withColumn("new", F.lit(True)), "digest", "left")


def deduplicate(docs: DataFrame, index: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept.  ``index`` learns the new texts."""
    rows = written(digests(docs, key, text), "digests")
    groups = written(append_new(rows, index), "decided")
    largest = written(groups.orderBy(F.desc("group_size"), "digest").limit(LARGEST), "largest-groups")
    hot = F.broadcast(largest)
    both = rows.join(hot, "digest").unionByName(
        rows.join(F.broadcast(largest.select("digest")), "digest", "left_anti").join(groups, "digest")
    )
    return both.select(
        "id", "digest", "keep_id", "group_size",
        F.coalesce("new", F.lit(False)).alias("_new"), (F.col("last.row") == F.col("row")).alias("_last"),
    ).select("id", "digest", "keep_id", "group_size", (F.col("_new") & F.col("_last")).alias("kept"))


def keep_first(docs: DataFrame, index: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = deduplicate(docs, index, key, text).where("kept").select("id", "digest")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    whole = docs.select(F.struct("*").alias("doc"), F.col(key).cast("long").alias("id"), digest.alias("digest"))
    kept = kept.select(F.col("id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    found = whole.join(kept, whole.id.eqNullSafe(kept.kept_id) & (whole.digest == kept.kept_digest), "left_semi")
    return found.dropDuplicates(["id", "digest"]).select("doc.*")  # one of rows that repeat id and text
