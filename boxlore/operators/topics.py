"""Topics over log messages."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, functions as F

from boxlore.functions.text import label_line, mask_addresses, words
from boxlore.session import cut_lineage


def prefixed(path: Column, message: Column, root: str = "") -> Column:
    """``[directory/file] message`` with the root folder left out."""
    relative = F.replace(path, F.lit(root), F.lit("")) if root else path
    return F.concat(F.lit("["), relative, F.lit("] "), message)


def message_words(message: Column) -> Column:
    """Words of a message after labelling its parts and masking addresses."""
    return words(mask_addresses(label_line(message)))


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct words of all messages."""
    return df.select(F.explode(tokens).alias("term")).distinct()


def fit_topics(df: DataFrame, k: int, tokens: str = "tokens", vocabulary_size: int = 20_000, iterations: int = 10) -> PipelineModel:
    return Pipeline(stages=[
        CountVectorizer(inputCol=tokens, outputCol="_counts", vocabSize=vocabulary_size),
        LDA(k=k, featuresCol="_counts", optimizer="online", maxIter=iterations, seed=42),
    ]).fit(df)


def topic_terms(model: PipelineModel, terms: int = 10) -> DataFrame:
    """(topic, place, term, weight): the strongest terms of each topic."""
    names = model.stages[0].vocabulary
    lookup = F.array(*[F.lit(n) for n in names]) if len(names) <= 2_000 else None
    described = model.stages[1].describeTopics(terms)
    rows = described.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    rows = rows.select("topic", "place", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    if lookup is not None:
        return rows.select("topic", "place", F.element_at(lookup, F.col("i") + 1).alias("term"), "weight")
    table = described.sparkSession.createDataFrame(list(enumerate(names)), "i int, term string")
    return rows.join(F.broadcast(table), "i").select("topic", "place", "term", "weight")  # one row per vocabulary word


def topic_overview(model: PipelineModel, terms: int = 10) -> DataFrame:
    """(topic, terms): one line per topic for the report file."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "term")))
    return topic_terms(model, terms).groupBy("topic").agg(
        F.array_join(F.transform(ordered, lambda x: x["term"]), ", ").alias("terms")
    )


def write_overview(model: PipelineModel, path: str) -> None:
    topic_overview(model).orderBy("topic").write.mode("overwrite").option("header", "true").csv(path)


def coherence(df: DataFrame, topics: dict[int, list[str]], tokens: str = "tokens") -> DataFrame:
    """(topic, coherence): mean normalised pointwise mutual information of each
    topic's word pairs over documents.  Pairs that never meet score -1.

    The words and pairs are a fixed short list (45 pairs for ten words); a
    document only adds to the counts of those it contains."""
    pairs = sorted({tuple(sorted(p)) for names in topics.values() for p in combinations(names, 2)})
    names = sorted({n for p in pairs for n in p})
    have = F.array_intersect(F.array_distinct(tokens), F.array(*[F.lit(n) for n in names]))
    met = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    docs = df.select(have.alias("have")).where(F.size("have") > 0)
    alone = F.transform("have", lambda w: F.struct(w.alias("a"), w.alias("b")))
    together = F.filter(met, lambda p: F.array_contains("have", p["a"]) & F.array_contains("have", p["b"]))
    # one pass counts words (as pairs with themselves) and pairs; written, or each use below would read the text again
    counts = cut_lineage(docs.select(F.explode(F.concat(alone, together)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    single = counts.where("a = b").select(F.col("a").alias("w"), "n")
    both = counts.where("a <> b").select("a", "b", F.col("n").alias("n_ab"))
    spark = df.sparkSession
    wanted = spark.createDataFrame(
        [(t, *sorted(p)) for t, ns in topics.items() for p in combinations(ns, 2)], "topic int, a string, b string")
    total = df.agg(F.count("*").alias("n")).scalar().cast("double")
    scored = (
        wanted.join(both, ["a", "b"], "left")
        .join(single.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a", "left")
        .join(single.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b", "left")
    )
    p = F.col("n_ab") / total
    pmi = F.ln(F.col("n_ab") * total / (F.col("n_a") * F.col("n_b")))
    npmi = F.when(F.col("n_ab").isNull(), F.lit(-1.0)).when(p == 1.0, F.lit(1.0)).otherwise(pmi / -F.ln(p))
    return scored.groupBy("topic").agg(F.avg(npmi).alias("coherence"))


def pick_topic_count(df: DataFrame, counts=range(5, 31, 5), tokens: str = "tokens", iterations: int = 10) -> tuple[int, PipelineModel]:
    """The topic count with the highest mean coherence, and its model."""
    best = None
    for k in counts:
        model = fit_topics(df, k, tokens, iterations=iterations)
        listed: dict[int, list[str]] = {}
        for row in topic_terms(model).orderBy("topic", "place").collect():  # k * 10 rows
            listed.setdefault(row["topic"], []).append(row["term"])
        score = coherence(df, listed, tokens).agg(F.avg("coherence")).first()[0]
        if best is None or score > best[0]:
            best = (score, k, model)
    return best[1], best[2]


def refit_topics(chunks: DataFrame, new: DataFrame, k: int, tokens: str = "tokens") -> PipelineModel:
    """Topics over everything seen so far (the model has no warm start)."""
    return fit_topics(chunks.select(tokens).unionByName(new.select(tokens)), k, tokens)
