"""Gradients, training over Spark, saved networks, and scores against linear forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlore.operators import anomaly, network


@pytest.mark.parametrize("shape, width", [(network.Layered((3, 5, 2, 4)), 3), (network.Recurrent(4, 2, 3, 2), 8)])
def test_gradient_is_the_slope_of_the_error(shape, width):
    chance = np.random.default_rng(0)
    weights = network._start(shape.shapes(), 1) + 0.1 * chance.normal(size=len(network._start(shape.shapes(), 1)))
    inputs, targets = chance.normal(size=(6, width)), chance.normal(size=(6, shape.shapes()[-1][0]))
    error = lambda w: ((shape.outputs(w, inputs)[0] - targets) ** 2).mean(axis=1).sum()
    made, given = shape.outputs(weights, inputs)
    slope = shape.gradient(weights, given, 2 * (made - targets) / targets.shape[1])
    for at in range(len(weights)):
        step = np.zeros_like(weights)
        step[at] = 1e-6
        assert abs((error(weights + step) - error(weights - step)) / 2e-6 - slope[at]) < 1e-5


def test_autoencoder_beats_axes_on_a_curve(spark, tmp_path):
    """Points on a half circle: one curved coordinate, but no line is near them."""
    angle = F.col("id") / 400 * np.pi
    df = spark.range(401).select(F.lit("a").alias("rxid"), "id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))
    model = anomaly.fit_autoencoder(df, ["x", "y"], latent=1, epochs=110, steps=1, rate=0.02)
    assert model.losses[-1] < 0.3 * model.losses[0]
    scored = anomaly.score_autoencoder(model, df, ["x", "y"])
    curved = scored.agg(F.avg("recon_score")).first()[0]
    z = anomaly.standardize(df, {"x": "_zx", "y": "_zy"}, ["rxid"])
    linear = anomaly.score_reconstruction(anomaly.fit_reconstruction(z, ["_zx", "_zy"], 1), z).agg(F.avg("recon_score")).first()[0]
    assert curved < linear / 2
    model.save(spark, str(tmp_path / "model"))
    again = anomaly.score_autoencoder(network.load(spark, str(tmp_path / "model")), df, ["x", "y"])
    assert {r["id"]: r["recon_score"] for r in again.collect()} == {r["id"]: r["recon_score"] for r in scored.collect()}


def test_recurrent_forecast_learns_a_rhythm(spark, tmp_path):
    """Messages whose length repeats every four rows: nothing a mean could tell; one row out of step."""
    day = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 10)
    size = F.when(F.col("id") == 350, 30).otherwise(F.element_at(F.array(*[F.lit(n) for n in (5, 20, 5, 40)]), (F.col("id") % 4 + 1).cast("int")))
    df = spark.range(400).select(F.concat(F.lit("R"), (F.col("id") % 1).cast("string")).alias("rxid"), "id", day.alias("timestamp"), F.repeat(F.lit("x"), size).alias("data"))
    model = anomaly.fit_recurrent(df.where("id < 300"), length=9, epochs=25, steps=2, rate=0.03)
    assert model.losses[-1] < 0.25 * model.losses[0]
    scores = {r["id"]: r for r in anomaly.score_recurrent(model, df).collect()}
    assert set(scores) == set(range(8, 400)) and scores[350]["seq_is_anomaly"]
    assert scores[350]["seq_score"] > 20 * np.median([r["seq_score"] for r in scores.values()])
    model.save(spark, str(tmp_path / "m"))
    loaded = network.load(spark, str(tmp_path / "m"))
    assert loaded.network == model.network and loaded.losses == model.losses
    assert {r["id"]: r["seq_score"] for r in anomaly.score_recurrent(loaded, df).collect()} == {k: r["seq_score"] for k, r in scores.items()}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "inputs array<double>, targets array<double>")
    trained = network.fit(none, network.Layered((2, 3, 2)), epochs=2, steps=2)
    assert trained.losses == (0.0, 0.0)
    odd = spark.createDataFrame([([1.0, None], [1.0, 2.0]), ([1.0, float("nan")], [1.0, 2.0]), (None, [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0])], none.schema)
    assert network.fit(odd, network.Layered((2, 3, 2)), epochs=1, steps=1).losses[0] > 0
