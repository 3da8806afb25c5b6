"""Message embeddings: which rows to embed, the vectors, and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from boxlore.functions.text import words
from boxlore.functions.timestamps import missing_filled
from boxlore.plans.groups import dense_codes
from boxlore.plans.skew import join_per_key


def split_sources(df: DataFrame, embedded: DataFrame, column: str = "source_table") -> tuple[DataFrame, DataFrame]:
    """(sources without any embedding, sources with some)."""
    sources, known = df.select(column).distinct(), embedded.select(column).distinct()
    return sources.join(known, column, "left_anti"), sources.join(known, column, "left_semi")


def newer_rows(df: DataFrame, embedded: DataFrame, column: str = "source_table") -> DataFrame:
    """Rows later than what is embedded of their source, and all rows of new sources."""
    counts = df.groupBy(column).agg(F.count("*").alias("_rows"))
    marks = counts.join(embedded.groupBy(column).agg(F.max("timestamp").alias("_mark")), column, "left")
    joined = join_per_key(df, marks, [column], "_rows")
    return joined.where(F.col("_mark").isNull() | (F.col("timestamp") > F.col("_mark"))).drop("_mark")


def with_timestamps(df: DataFrame, run_time: Column) -> DataFrame:
    """Missing stamps become the run time and are flagged."""
    stamp, imputed = missing_filled(F.col("timestamp"), run_time)
    return df.withColumn("timestamp_imputed", imputed).withColumn("timestamp", stamp)


def fit_words(df: DataFrame, size: int = 64, min_count: int = 5, partitions: int | None = None) -> Word2VecModel:
    """Word vectors trained on all messages, in parallel parts that are averaged.

    ``min_count`` bounds the vocabulary; raise it with the amount of text."""
    rows = df.select(words(F.col("data")).alias("_words"))
    parts = partitions or df.sparkSession.sparkContext.defaultParallelism
    return Word2Vec(
        vectorSize=size, minCount=min_count, numPartitions=parts, seed=42, inputCol="_words", outputCol="_vector", maxIter=1,
    ).fit(rows)


def embed_with_words(model: Word2VecModel, df: DataFrame) -> DataFrame:
    """Mean of the word vectors of each message."""
    out = model.transform(df.withColumn("_words", words(F.col("data"))))
    return out.withColumn("embedding", vector_to_array("_vector", "float32")).drop("_words", "_vector")


def embed_with(factory: Callable, df: DataFrame, size: int, batch_size: int = 256) -> DataFrame:
    """Any batch embedder: ``factory`` loads the model once per Python worker and
    returns a function from an array of texts to a 2-d array."""
    embed = predict_batch_udf(factory, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", embed(F.coalesce("data", F.lit(""))))


def norm(vector: Column) -> Column:
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(total)


def landscape(embedded: DataFrame, column: str = "source_table") -> DataFrame:
    """Rows with stamp and vector, the vector norm, and the source as a number."""
    rows = embedded.dropna(how="any", subset=["timestamp", "embedding"])
    counts = rows.groupBy(column).agg(F.count("*").alias("_rows"))
    codes = counts.join(dense_codes(rows, column, "source_code"), column)
    return join_per_key(rows.withColumn("norm", norm(F.col("embedding"))), codes, [column], "_rows")
