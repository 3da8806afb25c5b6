"""Small networks trained by Spark: gradients per task, summed over the cluster.

The rows of one step are a folder of examples.  Each task adds up loss and gradient of its
rows, batch by batch; the sums of all tasks are added up by an aggregation with one row
per weight, so the driver only ever sees the network (some thousand numbers) and takes the
step (Adam).  Every row is used once an epoch.  Scoring is one pass with the weights in
the tasks.  A network is saved with its shape.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from boxlore.session import checkpoint_dir


def _cut(weights: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(weights[at : at + size].reshape(shape))
        at += size
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([part.ravel() for part in parts])


def _start(shapes: list[tuple[int, ...]], seed: int) -> np.ndarray:
    """Matrices uniform within one over the root of their inputs, offsets zero."""
    chance = np.random.default_rng(seed)
    return _joined([chance.uniform(-1, 1, s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s) for s in shapes])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass(frozen=True)
class Layered:
    """Fully connected layers, each but the last cut off at zero; ``sizes`` from inputs to outputs."""

    sizes: tuple[int, ...]

    def shapes(self) -> list[tuple[int, ...]]:
        return [s for a, b in zip(self.sizes, self.sizes[1:]) for s in ((a, b), (b,))]

    def outputs(self, weights: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The outputs, and what every layer was given."""
        parts, given = _cut(weights, self.shapes()), [inputs]
        for at in range(0, len(parts), 2):
            made = given[-1] @ parts[at] + parts[at + 1]
            given.append(np.maximum(made, 0) if at + 2 < len(parts) else made)
        return given.pop(), given

    def gradient(self, weights: np.ndarray, given: list[np.ndarray], slope: np.ndarray) -> np.ndarray:
        parts, out = _cut(weights, self.shapes()), []
        for at, values in zip(range(len(parts) - 2, -1, -2), reversed(given)):
            out += [slope.sum(axis=0), values.T @ slope]
            slope = (slope @ parts[at].T) * (values > 0)
        return _joined(out[::-1])


@dataclass(frozen=True)
class Recurrent:
    """A long short-term memory over ``steps`` rows of ``features``; its last state gives the outputs linearly."""

    steps: int
    features: int
    hidden: int
    out: int

    def shapes(self) -> list[tuple[int, ...]]:
        return [(self.features, 4 * self.hidden), (self.hidden, 4 * self.hidden), (4 * self.hidden,), (self.hidden, self.out), (self.out,)]

    def outputs(self, weights: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, list]:
        from_input, from_state, offset, to_out, out_offset = _cut(weights, self.shapes())
        series = inputs.reshape(len(inputs), self.steps, self.features)
        state = cell = np.zeros((len(inputs), self.hidden))
        trace = []
        for step in range(self.steps):
            entry, keep, show, new = np.split(series[:, step] @ from_input + state @ from_state + offset, 4, axis=1)
            entry, keep, show, new = _sigmoid(entry), _sigmoid(keep), _sigmoid(show), np.tanh(new)
            before, cell_before = state, cell
            cell = keep * cell + entry * new
            state = show * np.tanh(cell)
            trace.append((series[:, step], before, cell_before, entry, keep, show, new, np.tanh(cell)))
        return state @ to_out + out_offset, [trace, state]

    def gradient(self, weights: np.ndarray, given: list, slope: np.ndarray) -> np.ndarray:
        """Back through all steps."""
        from_input, from_state, offset, to_out, _ = _cut(weights, self.shapes())
        trace, last = given
        sums = [np.zeros_like(from_input), np.zeros_like(from_state), np.zeros_like(offset), last.T @ slope, slope.sum(axis=0)]
        state_slope, cell_slope = slope @ to_out.T, 0.0
        for values, before, cell_before, entry, keep, show, new, shown in reversed(trace):
            cell_slope = cell_slope + state_slope * show * (1 - shown * shown)
            gates = np.concatenate([
                cell_slope * new * entry * (1 - entry), cell_slope * cell_before * keep * (1 - keep),
                state_slope * shown * show * (1 - show), cell_slope * entry * (1 - new * new)], axis=1)
            sums[0] += values.T @ gates
            sums[1] += before.T @ gates
            sums[2] += gates.sum(axis=0)
            state_slope, cell_slope = gates @ from_state.T, cell_slope * keep
        return _joined(sums)


KINDS = {"layered": Layered, "recurrent": Recurrent}


@dataclass(frozen=True)
class Trained:
    """A network with its weights, and the mean error of each epoch."""

    network: Layered | Recurrent
    weights: np.ndarray
    losses: tuple[float, ...]

    def errors(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Mean squared error of each row."""
        return ((self.network.outputs(self.weights, inputs)[0] - targets) ** 2).mean(axis=1)

    def score(self, df: DataFrame, inputs: str, targets: str, out: str) -> DataFrame:
        """``df`` with the error of each row."""
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
        at, target = df.columns.index(inputs), df.columns.index(targets)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = self.errors(_matrix(batch.column(at)), _matrix(batch.column(target))) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

        return df.mapInArrow(work, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        kind = next(name for name, made in KINDS.items() if isinstance(self.network, made))
        config = json.dumps({"kind": kind, "losses": self.losses, **asdict(self.network)})
        row = [(config, self.weights.tolist())]
        spark.createDataFrame(row, "config string, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Trained:
    row = spark.read.parquet(path).first()
    config = json.loads(row.config)
    kind, losses = KINDS[config.pop("kind")], tuple(config.pop("losses"))
    shape = {k: tuple(v) if isinstance(v, list) else v for k, v in config.items()}
    return Trained(kind(**shape), np.array(row.weights), losses)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _step(rows: DataFrame, network: Layered | Recurrent, weights: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Rows, sum of their errors, and its gradient."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, loss, total = 0, 0.0, np.zeros(len(weights))
        for batch in batches:
            if batch.num_rows:
                inputs, targets = _matrix(batch.column(0)), _matrix(batch.column(1))
                made, given = network.outputs(weights, inputs)
                off = made - targets
                count, loss = count + len(off), loss + float((off * off).mean(axis=1).sum())
                total += network.gradient(weights, given, 2 * off / off.shape[1])
        if count:
            values = np.concatenate([[count, loss], total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["place", "value"])

    sums = rows.mapInArrow(work, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = np.zeros(len(weights) + 2)
    for row in sums.collect():  # one row per weight
        found[row.place] = row.value
    return int(found[0]), float(found[1]), found[2:]


def fit(examples: DataFrame, network: Layered | Recurrent, epochs: int = 10, steps: int = 8, rate: float = 0.01, seed: int = 42) -> Trained:
    """Train on ``examples`` (inputs array<double>, targets array<double>), in ``steps`` parts an epoch.

    The examples are written once, a folder for each step; rows with a missing number are left out."""
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    folder = f"{checkpoint_dir(examples.sparkSession)}/examples/{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("inputs", "targets"), F.lit(steps)).cast("int")
    kept = examples.select("inputs", "targets").where(whole("inputs") & whole("targets"))
    kept.withColumn("step", part).write.partitionBy("step").parquet(folder)
    written = examples.sparkSession.read.schema("inputs array<double>, targets array<double>, step int").parquet(folder)
    weights = _start(network.shapes(), seed)
    mean, square, taken, losses = np.zeros_like(weights), np.zeros_like(weights), 0, []
    for _ in range(epochs):
        rows = loss = 0.0
        for step in range(steps):
            count, error, slope = _step(written.where(F.col("step") == step).select("inputs", "targets"), network, weights)
            if not count:
                continue
            slope /= count
            taken += 1
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
            weights = weights - rate * (mean / (1 - 0.9**taken)) / (np.sqrt(square / (1 - 0.999**taken)) + 1e-8)
            rows, loss = rows + count, loss + error
        losses.append(loss / rows if rows else 0.0)
    return Trained(network, weights, tuple(losses))
