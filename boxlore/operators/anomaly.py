"""Anomaly scores: thresholds, reconstruction error, sequence forecast error."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boxlore.operators import network
from boxlore.plans.ordered import SEGMENT, ranked_blocks, time_slice
from boxlore.plans.skew import join_per_key
from boxlore.session import cut_lineage

SEQUENCE = 16


# --- statistics per scope joined back -------------------------------------------------


def _with_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Aggregates per key as columns; without keys, as one-row scalar subqueries."""
    if keys:
        per_key = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in stats.items()])
        return join_per_key(df, per_key, keys, "_rows")
    one = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"))
    return df.withColumns({n: one.scalar()[n] for n in stats})


def data_length(data: str = "data") -> Column:
    return F.coalesce(F.length(data), F.lit(0))


def add_threshold(df: DataFrame, value: str, keys: list[str], threshold: str = "threshold",
                  flag: str = "is_anomaly") -> DataFrame:
    """Mean plus two population deviations; strictly above it is an anomaly."""
    limit = F.avg(value) + 2 * F.stddev_pop(value)
    return _with_stats(df, keys, {threshold: limit}).withColumn(flag, F.col(value) > F.col(threshold))


def min_max(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """``value`` scaled to 0..1 per key; unchanged where it is constant."""
    low, high = F.col("_low"), F.col("_high")
    out = _with_stats(df, keys, {"_low": F.min(value), "_high": F.max(value)})
    scaled = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.col(value))
    return out.withColumn(name, scaled).drop("_low", "_high")


def standardize(df: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1 per key; constants give 0."""
    stats = {}
    for c in columns:
        stats |= {f"_mean_{c}": F.avg(c), f"_dev_{c}": F.stddev_pop(c)}
    out = _with_stats(df, keys, stats)
    z = {
        name: F.when(F.col(f"_dev_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_dev_{c}"))
        for c, name in columns.items()
    }
    return out.withColumns(z).drop(*stats)


def severity(flag: Column, score: Column, threshold: Column) -> Column:
    over = score - threshold
    return (
        F.when(~flag, F.lit("normal")).when(over > 0.2, F.lit("critical")).when(over > 0.1, F.lit("warning"))
        .otherwise(F.lit("anomaly"))
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts per equal-width bin from minimum to maximum, last bin closed, with the
    threshold line (mean plus two deviations)."""
    stats = _with_stats(df.select(value), [], {
        "_low": F.min(value), "_high": F.max(value), "threshold": F.avg(value) + 2 * F.stddev_pop(value),
    })
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    counted = stats.groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"), "_low", "_high", "threshold").count()
    return counted.select(
        "bin", (F.col("_low") + F.col("bin") * width).alias("lower"), F.col("count").alias("n"), "threshold"
    )


# --- reconstruction error ----------------------------------------------------------------


def reconstruction_scores(df: DataFrame, columns: list[str], keys: list[str] = ["rxid"]) -> DataFrame:
    """Error against the mean alone: the mean squared standard value (no latent dimensions)."""
    z = standardize(df, {c: f"_z_{c}" for c in columns}, keys)
    error = reduce(lambda a, b: a + b, [F.col(f"_z_{c}") * F.col(f"_z_{c}") for c in columns]) / len(columns)
    out = z.withColumn("recon_score", error).drop(*[f"_z_{c}" for c in columns])
    return add_threshold(out, "recon_score", keys, "recon_threshold", "recon_is_anomaly")


def fit_reconstruction(df: DataFrame, columns: list[str], latent: int) -> PipelineModel:
    """Linear auto-encoder: the first ``latent`` principal axes of standardised columns."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_vector"),
        PCA(k=latent, inputCol="_vector", outputCol="_latent"),
    ]).fit(df)


def score_reconstruction(model: PipelineModel, df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Mean squared difference between a row and its projection on the axes."""
    axes = model.stages[-1].pc.toArray()
    out = model.transform(df).withColumn("_x", vector_to_array("_vector")).withColumn("_y", vector_to_array("_latent"))
    errors = []
    for i, weights in enumerate(axes):
        back = reduce(lambda a, b: a + b, [F.col("_y")[j] * float(w) for j, w in enumerate(weights)])
        errors.append((F.col("_x")[i] - back) * (F.col("_x")[i] - back))
    error = reduce(lambda a, b: a + b, errors) / len(errors)
    out = out.withColumn("recon_score", error).drop("_x", "_y", "_vector", "_latent")
    return add_threshold(out, "recon_score", keys, "recon_threshold", "recon_is_anomaly")


# --- sequences -----------------------------------------------------------------------------


def sequence_rows(df: DataFrame, length: int = SEQUENCE, keys: list[str] = ["rxid"]) -> DataFrame:
    """Rows with message length and seconds since the previous row, in blocks that
    also hold copies of the ``length`` rows before them (see plans.ordered)."""
    timed = df.where("timestamp IS NOT NULL").withColumn("data_len", data_length().cast("double"))
    blocks = ranked_blocks(
        timed.withColumn(SEGMENT, time_slice(F.col("timestamp"))), keys, ["timestamp", "id"], overlap=length
    )
    w = W.partitionBy(*keys, "_block").orderBy("_rank")
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    gap = (micros - F.lag(micros).over(w)) / F.lit(1e6)
    return blocks.withColumn("delta_s", F.coalesce(gap, F.lit(0.0)))


def sequences(df: DataFrame, length: int = SEQUENCE, keys: list[str] = ["rxid"]) -> DataFrame:
    """The last ``length`` rows up to each row, as an array; only full ones."""
    w = W.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(-(length - 1), 0)
    rows = sequence_rows(df, length, keys)
    rows = rows.withColumn("sequence", F.collect_list(F.struct("data_len", "delta_s")).over(w))
    return rows.where(~F.col("_copy") & (F.col("_rank") >= length)).drop("_block", "_copy", "_rank")


def _finish_sequences(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Scale errors to 0..1, set the threshold and the severity.

    Scaling is linear, so the threshold of the scaled errors follows from one
    set of statistics of the raw ones."""
    out = _with_stats(errors, keys, {
        "_low": F.min("_error"), "_high": F.max("_error"), "_mean": F.avg("_error"), "_dev": F.stddev_pop("_error"),
    })
    low, span = F.col("_low"), F.col("_high") - F.col("_low")
    raw = F.col("_mean") + 2 * F.col("_dev")
    out = out.withColumns({
        "seq_score": F.when(span > 0, (F.col("_error") - low) / span).otherwise(F.col("_error")),
        "seq_threshold": F.when(span > 0, (raw - low) / span).otherwise(raw),
    }).drop("_error", "_low", "_high", "_mean", "_dev")
    flag = F.col("seq_score") > F.col("seq_threshold")
    return out.withColumn("seq_is_anomaly", flag).withColumn(
        "seq_issue", severity(F.col("seq_is_anomaly"), F.col("seq_score"), F.col("seq_threshold"))
    )


def score_sequences(df: DataFrame, length: int = SEQUENCE, keys: list[str] = ["rxid"],
                    materialize: bool = True) -> DataFrame:
    """Forecast of each row as the mean of the ``length - 1`` rows before it.

    The squared error is taken in units of the receiver's deviation, averaged
    over both features, scaled to 0..1 and compared with its threshold.  Rows
    without a full sequence are not scored.

    The statistics need further passes over the windowed rows.  Narrow feature
    rows (keys, id, stamp, numbers) are therefore written once to the shared
    checkpoint folder, and the result has those columns only; ``attach_scores``
    brings it back to the rows.  Without ``materialize`` everything stays lazy."""
    if materialize:
        df = df.select(*keys, "id", "timestamp", "data")
    features = ["data_len", "delta_s"]
    w = W.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(-(length - 1), -1)
    rows = sequence_rows(df, length, keys)
    rows = rows.withColumns({f"_back_{c}": F.avg(c).over(w) for c in features}).where(~F.col("_copy"))
    if materialize:
        rows = cut_lineage(rows.drop("data"))
    rows = _with_stats(rows, keys, {f"_dev_{c}": F.stddev_pop(c) for c in features})
    parts = [
        F.when(F.col(f"_dev_{c}") == 0, F.lit(0.0)).otherwise(
            F.pow((F.col(c) - F.col(f"_back_{c}")) / F.col(f"_dev_{c}"), 2))
        for c in features
    ]
    errors = rows.where(F.col("_rank") >= length).withColumn("_error", (parts[0] + parts[1]) / 2)
    errors = errors.drop("_block", "_copy", "_rank", *[f"_{n}_{c}" for n in ("back", "dev") for c in features])
    return _finish_sequences(errors, keys)


def _lag_vectors(df: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """Standardised features of each row and, as a vector, of the rows before it."""
    rows = sequence_rows(df, length, keys)
    stats = rows.where(~F.col("_copy")).groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.avg("data_len").alias("_ml"), F.stddev_pop("data_len").alias("_sl"),
        F.avg("delta_s").alias("_mg"), F.stddev_pop("delta_s").alias("_sg"),
    )
    unit = lambda c, m, s: F.when(F.col(s) == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(m)) / F.col(s))
    rows = join_per_key(rows, stats, keys, "_rows").withColumns({"_z_len": unit("data_len", "_ml", "_sl"), "_z_gap": unit("delta_s", "_mg", "_sg")})
    w = W.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(-(length - 1), -1)
    rows = rows.withColumn("_lags", F.flatten(F.collect_list(F.array("_z_len", "_z_gap")).over(w)))
    full = rows.where(~F.col("_copy") & (F.col("_rank") >= length))
    return full.withColumn("_lags", array_to_vector("_lags")).drop("_block", "_copy", "_rank", "_ml", "_sl", "_mg", "_sg")


def fit_forecaster(df: DataFrame, length: int = SEQUENCE, keys: list[str] = ["rxid"]) -> list:
    """One linear model per feature on the lagged features (train on known-good rows)."""
    rows = cut_lineage(_lag_vectors(df, length, keys).select("_lags", "_z_len", "_z_gap"))  # read by both fits
    return [
        LinearRegression(featuresCol="_lags", labelCol=target, predictionCol=f"_p{target}", regParam=0.01).fit(rows)
        for target in ("_z_len", "_z_gap")
    ]


def score_forecast(models: list, df: DataFrame, length: int = SEQUENCE, keys: list[str] = ["rxid"]) -> DataFrame:
    """Scores (keys, id, stamp) by the fitted models; errors are written once, as above."""
    rows = _lag_vectors(df.select(*keys, "id", "timestamp", "data"), length, keys).drop("data")
    for model in models:
        rows = model.transform(rows)
    error = (F.pow(F.col("_z_len") - F.col("_p_z_len"), 2) + F.pow(F.col("_z_gap") - F.col("_p_z_gap"), 2)) / 2
    rows = rows.withColumn("_error", error).drop("_lags", "_z_len", "_z_gap", "_p_z_len", "_p_z_gap")
    return _finish_sequences(cut_lineage(rows), keys)


def _lag_arrays(df: DataFrame, length: int, keys: list[str]) -> DataFrame:
    rows = _lag_vectors(df, length, keys)
    return rows.withColumns({"inputs": vector_to_array("_lags"), "targets": F.array("_z_len", "_z_gap")}).drop("_lags", "_z_len", "_z_gap")


def fit_recurrent(df: DataFrame, length: int = SEQUENCE, keys: list[str] = ["rxid"], hidden: int = 16, **training) -> network.Trained:
    """A recurrent forecaster of a row from the ``length - 1`` rows before it (train on known-good rows)."""
    shape = network.Recurrent(steps=length - 1, features=2, hidden=hidden, out=2)
    return network.fit(_lag_arrays(df, length, keys), shape, **training)


def score_recurrent(model: network.Trained, df: DataFrame, keys: list[str] = ["rxid"]) -> DataFrame:
    """Scores (keys, id, stamp) by a fitted forecaster; errors are written once, as above."""
    rows = _lag_arrays(df.select(*keys, "id", "timestamp", "data"), model.network.steps + 1, keys)
    rows = rows.select(*keys, "id", "timestamp", "data_len", "delta_s", "inputs", "targets")
    return _finish_sequences(cut_lineage(model.score(rows, "inputs", "targets", "_error").drop("inputs", "targets")), keys)


def _standard_arrays(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    z = standardize(df, {c: f"_z_{c}" for c in columns}, keys)
    return z.withColumn("inputs", F.array(*[F.coalesce(F.col(f"_z_{c}"), F.lit(0.0)) for c in columns])).drop(*[f"_z_{c}" for c in columns])


def fit_autoencoder(df: DataFrame, columns: list[str], latent: int = 2, width: int = 64, keys: list[str] = ["rxid"], **training) -> network.Trained:
    """An auto-encoder of the standardised columns through a layer of ``latent`` numbers."""
    rows = _standard_arrays(df, columns, keys)
    shape = network.Layered((len(columns), width, latent, width, len(columns)))
    return network.fit(rows.select("inputs", F.col("inputs").alias("targets")), shape, **training)


def score_autoencoder(model: network.Trained, df: DataFrame, columns: list[str], keys: list[str] = ["rxid"]) -> DataFrame:
    """Mean squared difference between a row's standardised columns and what the network makes of them."""
    out = model.score(_standard_arrays(df, columns, keys), "inputs", "inputs", "recon_score").drop("inputs")
    return add_threshold(cut_lineage(out), "recon_score", keys, "recon_threshold", "recon_is_anomaly")


def attach_scores(df: DataFrame, scores: DataFrame, keys: list[str] = ["rxid", "id"]) -> DataFrame:
    """Scores computed elsewhere as columns of the rows they belong to."""
    new = [c for c in scores.columns if c not in df.columns]
    return df.join(scores.select(*keys, *new), keys, "left")
