"""Which columns tell something about the event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boxlore.functions import fixed_values as fixed
from boxlore.plans.groups import top_per_group
from boxlore.sources.tables import add_missing

LABEL = "event_type"


def sample_rows(df: DataFrame, n: int, keys: list[str] = ["rxid"], seed: int = 0) -> DataFrame:
    """``n`` rows per key, picked by a seeded hash of the id (repeatable)."""
    return top_per_group(df, keys, [F.xxhash64("id", F.lit(seed)), F.col("id")], n)


def mutual_information(df: DataFrame, columns: list[str], label: Column, keys: list[str] = [],
                       value=lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("NULL"))) -> DataFrame:
    """(keys, column, mi, n_values): mutual information in nats of each column and the label.

    All columns go through one count of (column, value, label).  Both marginal
    counts come from that count, and

        MI = ln N + (sum nxy ln nxy - sum nx ln nx - sum ny ln ny) / N

    needs no join of counts, so neither a frequent value nor a column with a
    billion values meets in one task.  Long values are counted by their md5."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])
    long = df.select(*keys, label.alias("label"), F.explode(cells).alias("cell")).select(
        *keys, "label", "cell.column",
        F.when(F.length("cell.value") > 32, F.md5("cell.value")).otherwise(F.col("cell.value")).alias("value"),
    )
    by = [*keys, "column"]
    joint = long.groupBy(*by, "value", "label").agg(F.count("*").cast("double").alias("n"))
    n_ln_n = F.sum(F.col("n") * F.ln("n"))
    both = joint.groupBy(*by).agg(n_ln_n.alias("xy"), F.sum("n").alias("total"))
    values = joint.groupBy(*by, "value").agg(F.sum("n").alias("n")).groupBy(*by).agg(
        n_ln_n.alias("x"), F.count("*").alias("n_values"))
    labels = joint.groupBy(*by, "label").agg(F.sum("n").alias("n")).groupBy(*by).agg(n_ln_n.alias("y"))
    mi = F.ln("total") + (F.col("xy") - F.col("x") - F.col("y")) / F.col("total")
    return both.join(values, by).join(labels, by).select(*by, F.greatest(mi, F.lit(0.0)).alias("mi"), "n_values")


def label_or_unknown() -> Column:
    return F.coalesce(F.nullif(LABEL, F.lit("")), F.lit("UNKNOWN"))


def relevant_columns(df: DataFrame, columns: list[str], k: int = 3, keys: list[str] = ["rxid"]) -> DataFrame:
    """(keys, column): the ``k`` most telling columns per receiver and the label
    itself; all columns where no row of the receiver has a label."""
    names = list(dict.fromkeys([*columns, LABEL]))
    scores = mutual_information(add_missing(df, names), names, label_or_unknown(), keys)
    labelled = df.groupBy(*keys).agg(F.max(label_or_unknown() != "UNKNOWN").alias("_labelled"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("mi", 9)), "column"))
    ranked = scores.withColumn("_rank", rank).join(labelled, keys)
    return ranked.where((F.col("_rank") <= k) | (F.col("column") == LABEL) | ~F.col("_labelled")).select(*keys, "column")


def columns_of_any(relevant: DataFrame) -> DataFrame:
    return relevant.select("column").distinct()


def hybrid_columns(df: DataFrame, columns: list[str], k: int = 5, keys: list[str] = ["rxid"]) -> DataFrame:
    """Columns of the hybrid model: the best ``k`` besides the label, and the fixed ones."""
    others = [c for c in columns if c != LABEL]
    scores = mutual_information(df, others, label_or_unknown(), keys)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("mi", 9)), "column"))
    best = scores.withColumn("_rank", rank).where(F.col("_rank") <= k).select("column")
    fixed_names = [LABEL, *fixed.DOMAIN_COLUMNS, *fixed.ALWAYS_TEXT]
    constant = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in fixed_names])).alias("column"))
    return best.union(constant).distinct()


def global_scores(df: DataFrame, columns: list[str], min_count: int = 1) -> DataFrame:
    """(column, mi) over labelled rows and whole values; a column with at most
    ``min_count`` values scores 0."""
    labelled = df.where(F.coalesce(F.col(LABEL), F.lit("")) != "")
    scores = mutual_information(labelled, columns, F.col(LABEL), [], lambda c: F.coalesce(c, F.lit("None")))
    return scores.select("column", F.when(F.col("n_values") <= min_count, 0.0).otherwise(F.col("mi")).alias("mi"))


def refine_columns(scores: DataFrame, history: DataFrame, min_mi: float = 1e-4, max_columns: int | None = None,
                   patience: int = 10) -> tuple[DataFrame, DataFrame]:
    """(kept columns, new history).  A column stays while its score is high enough or
    was low for fewer than ``patience`` runs in a row; the label always stays."""
    low = F.col("mi") < min_mi
    runs = F.when(low, F.coalesce("low_runs", F.lit(0)) + 1).otherwise(F.lit(0)).cast("int")
    updated = scores.join(history, "column", "left").withColumn("low_runs", runs)
    stable = updated.where(~low | (F.col("low_runs") < patience)).select("column", "mi")
    label = scores.sparkSession.range(1).select(F.lit(LABEL).alias("column"), F.lit(0.0).alias("mi"))
    stable = stable.unionByName(label).groupBy("column").agg(F.max("mi").alias("mi"))
    kept = stable if max_columns is None else stable.orderBy(F.desc("mi"), "column").limit(max_columns)
    gone = history.join(scores.select("column"), "column", "left_anti").select("column", "low_runs")
    return kept, updated.select("column", "low_runs").unionByName(gone)


def grow_master(master: DataFrame | None, columns: DataFrame) -> DataFrame:
    """Every column that was ever kept."""
    new = columns.select("column")
    return (new if master is None else master.select("column").union(new)).distinct()
