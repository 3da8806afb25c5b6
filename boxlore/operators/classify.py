"""Event-type classifiers."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import (
    IDF, PCA, CountVectorizer, FeatureHasher, IndexToString, Normalizer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from boxlore.functions import fixed_values as fixed
from boxlore.functions.text import index_terms
from boxlore.operators.enrich import feature_text, label
from boxlore.session import cut_lineage
from boxlore.sources.tables import add_missing

UNKNOWN = "UNKNOWN"


def training_rows(df: DataFrame, columns: list[str], require_event_type: bool = True) -> DataFrame:
    """Rows with a label, reduced to the columns the model reads."""
    names = list(dict.fromkeys([*columns, *fixed.EXTRA_FEATURES, "event_type", "category"]))
    rows = add_missing(df, names).select(*names)
    return rows.where("event_type IS NOT NULL AND event_type <> ''") if require_event_type else rows


def training_rows_or_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Labelled rows; all rows when none has a label (one row is looked for, not counted)."""
    labelled = training_rows(df, columns)
    return training_rows(df, columns, False) if labelled.isEmpty() else labelled


# --- term weights as rows -------------------------------------------------------------


def term_counts(df: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(id, term, tf)."""
    terms = df.select(id_column, F.explode(index_terms(text)).alias("term"))
    return terms.groupBy(id_column, "term").agg(F.count("*").alias("tf"))


def tfidf_terms(df: DataFrame, id_column: str, text: Column, max_features: int = 10_000) -> DataFrame:
    """(id, term, weight) with idf ``ln((1 + n) / (1 + df)) + 1`` and unit rows.

    Only the ``max_features`` terms used most stay.  That bound also makes the
    vocabulary safe to broadcast, and a row's window holds no more terms.  It is found
    first, so that no other term is shuffled, and a kept term travels as its place in it."""
    terms = df.select(id_column, F.explode(index_terms(text)).alias("term"))
    totals = terms.groupBy("term").agg(F.count("*").alias("total"))
    top = totals.orderBy(F.desc("total"), "term").limit(max_features).select("term")
    vocabulary = cut_lineage(top.coalesce(1).select("term", F.monotonically_increasing_id().cast("int").alias("place")))
    counts = terms.join(F.broadcast(vocabulary), "term").groupBy(id_column, "place").agg(F.count("*").alias("tf"))
    # asking for the totals too keeps tf, and so one shuffle of the counts for both uses
    found = counts.groupBy("place").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where("total > 0").select("place", "df")
    n = df.agg(F.count("*").alias("n")).scalar()
    idf = F.ln((n + 1) / (F.col("df") + 1)) + 1
    raw = counts.join(F.broadcast(found), "place").select(id_column, "place", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(id_column)))
    weighed = raw.select(id_column, "place", (F.col("w") / norm).alias("weight"))
    return weighed.join(F.broadcast(vocabulary), "place").select(id_column, "term", "weight")


# --- classifiers --------------------------------------------------------------------------


def _prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    df = add_missing(df, [*columns, *fixed.EXTRA_FEATURES, "event_type", "category"])
    return df.withColumn("_text", feature_text(columns)).withColumn("_terms", index_terms(F.col("_text")))


#: bytes of one task's rows while a forest grows: four for each feature of a row
TASK_BYTES = 128 << 20


def _dealt(rows: DataFrame, features: int) -> DataFrame:
    """Written rows in tasks of a bounded size, as a forest holds each row with all its features, however few are set."""
    most = max(1, TASK_BYTES // (4 * features))
    total, largest = rows.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    return cut_lineage(rows.repartition(-(-total // most))) if largest and largest > most else rows


def _label_stages(df: DataFrame, features: str, model_type: str, trees: int, depth: int) -> list:
    indexer = StringIndexer(inputCol="_label", outputCol="_index", handleInvalid="keep").fit(df)
    if model_type == "NaiveBayes":
        model = NaiveBayes(featuresCol=features, labelCol="_index", predictionCol="_class", modelType="multinomial")
    else:
        model = RandomForestClassifier(
            featuresCol=features, labelCol="_index", predictionCol="_class", numTrees=trees, maxDepth=depth, seed=42)
    return [indexer, model, IndexToString(inputCol="_class", outputCol="_predicted", labels=indexer.labels)]


def fit_text_classifier(df: DataFrame, columns: list[str], model_type: str = "RandomForest", max_features: int = 10_000,
                        trees: int = 100, depth: int = 10, counts_only: bool = False) -> PipelineModel:
    """TF-IDF (or plain counts) of the feature text into a forest or naive Bayes."""
    # every stage reads the training set; the text work is done once
    rows = _dealt(cut_lineage(_prepared(df, columns).select("_terms", label().alias("_label"))), max_features)
    counts = CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=max_features)
    stages = [counts]
    features = "_counts"
    if not counts_only:
        stages += [IDF(inputCol="_counts", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_features")]
        features = "_features"
    return Pipeline(stages=stages + _label_stages(rows, features, model_type, trees, depth)).fit(rows)


def predict_labels(model: PipelineModel | None, df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``predicted``; rows without text, and all rows without a model, are UNKNOWN."""
    if model is None:
        return df.withColumn("predicted", F.lit(UNKNOWN))
    out = model.transform(_prepared(df, columns).withColumn("_label", F.lit(UNKNOWN)))
    predicted = F.when(F.trim("_text") == "", F.lit(UNKNOWN)).otherwise(F.col("_predicted"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], predicted.alias("predicted"))


def feature_importances(model: PipelineModel, top: int = 20) -> list[tuple[str, float]]:
    """The terms a forest relies on most; the lists are bounded by the vocabulary size."""
    vocabulary = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    weights = forest.featureImportances
    ranked = sorted(zip(weights.indices.tolist(), weights.values.tolist()), key=lambda pair: (-pair[1], pair[0]))
    name = lambda i: vocabulary[i] if i < len(vocabulary) else f"feature_{i}"
    return [(name(i), w) for i, w in ranked[:top]]


# --- hybrid model ---------------------------------------------------------------------------


def split_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """(text columns, domain columns) of the hybrid model."""
    is_text = lambda c: c in fixed.ALWAYS_TEXT or c not in fixed.DOMAIN_COLUMNS
    return [c for c in columns if is_text(c) and c != "event_type"], [c for c in columns if not is_text(c)]


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, numeric, kind): numeric when every filled value is a number."""
    text = {c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns}
    one = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.count(t).alias("filled"), F.count(t.try_cast("double")).alias("numeric")).alias(f"_{i}")
        for i, (c, t) in enumerate(text.items())
    ])
    rows = one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(columns))])).alias("k")).select("k.*")
    numeric = (F.col("filled") > 0) & (F.col("filled") == F.col("numeric"))
    return rows.withColumn("kind", F.when(numeric, "numeric").otherwise("categorical"))


def _hybrid_prepared(df: DataFrame, columns: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    text, _ = split_columns(columns)
    df = add_missing(df, [*columns, "event_type", "category"])
    filled = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in text]
    df = df.withColumn("_terms", index_terms(F.concat_ws(" ", F.lit(""), *filled)))
    values = {f"_n_{c}": F.coalesce(F.col(f"`{c}`").cast("string").try_cast("double"), F.lit(0.0)) for c in numeric}
    values |= {f"_c_{c}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in categorical}
    return df.withColumns(values) if values else df


def fit_hybrid(df: DataFrame, columns: list[str], max_features: int = 1_000, axes: int = 50, buckets: int = 100,
               trees: int = 100, depth: int = 10) -> tuple[PipelineModel, dict]:
    """Text axes, scaled numbers and hashed categories into one forest.

    Returns the model and the column roles that prediction needs."""
    _, domain = split_columns(columns)
    kinds = {r["column"]: r["kind"] for r in column_kinds(add_missing(df, domain), domain).collect()} if domain else {}
    numeric = [c for c in domain if kinds[c] == "numeric"]
    categorical = [c for c in domain if kinds[c] == "categorical"]
    rows = _hybrid_prepared(df, columns, numeric, categorical).withColumn("_label", label())
    rows = cut_lineage(rows.select("_label", *[c for c in rows.columns if c == "_terms" or c[:3] in ("_n_", "_c_")]))
    rows = _dealt(rows, axes + len(numeric) + buckets)
    counts = CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=max_features).fit(rows)
    axes = min(axes, len(counts.vocabulary))
    stages = [counts, IDF(inputCol="_counts", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_tfidf"),
              PCA(k=axes, inputCol="_tfidf", outputCol="_axes")]
    parts = ["_axes"]
    if numeric:
        stages += [VectorAssembler(inputCols=[f"_n_{c}" for c in numeric], outputCol="_numbers"),
                   StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)]
        parts.append("_scaled")
    if categorical:
        stages.append(FeatureHasher(inputCols=[f"_c_{c}" for c in categorical], outputCol="_hashed", numFeatures=buckets))
        parts.append("_hashed")
    stages.append(VectorAssembler(inputCols=parts, outputCol="_features"))
    model = Pipeline(stages=stages + _label_stages(rows, "_features", "RandomForest", trees, depth)).fit(rows)
    return model, {"columns": columns, "numeric": numeric, "categorical": categorical}


def predict_hybrid(model: PipelineModel, roles: dict, df: DataFrame) -> DataFrame:
    rows = _hybrid_prepared(df, roles["columns"], roles["numeric"], roles["categorical"])
    out = model.transform(rows.withColumn("_label", F.lit(UNKNOWN)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_predicted").alias("predicted"))


# --- persistence -------------------------------------------------------------------------------


def model_path(root: str, name: str, **shape) -> str:
    """Folder of a model; ``shape`` (input size, latent size, ...) is part of the key."""
    return "/".join([root.rstrip("/"), name, *[f"{k}={shape[k]}" for k in sorted(shape)]])


def save_model(model: PipelineModel, config: dict, path: str) -> None:
    """Model and its configuration; writing again replaces both."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.range(1).select(F.lit(json.dumps(config, sort_keys=True)).alias("config")).write.mode("overwrite").json(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    config = spark.read.schema("config string").json(f"{path}/config").first()["config"]
    return PipelineModel.load(f"{path}/model"), json.loads(config)
