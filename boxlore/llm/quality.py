"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of plain numbers (``FEATURES``), each number a bin.  Training
goes round the features in turn and fits a shallow tree to what the model still gets
wrong; a feature's trees add up to one lookup table per feature.  Then the pairs with
the largest remaining gain are boosted in the same way into two-way tables.  A score is
the logistic function of the sum of one table entry per feature and pair.

Fitted on at most ``TRAINING_ROWS`` labelled rows (those whose hash is smallest); only
their numbers reach the driver.  Every row of the input is scored, over its whole text.

Defined results: null text counts as empty and gets a score like any other; labels that
are null, or of ids that documents lacks, are not used; with one class or none in
training the score is the smoothed share of label 1; repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boxlore.llm.common import small_batches

TRAINING_ROWS = 20_000
ACCEPT = 0.7
#: frequent function words of English, German, French and Spanish (fixed values)
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was on are with as be at by from this have not or an "
    "der die das und zu den mit von für auf ist im dem nicht ein eine des sich als auch "
    "le la les de et un une des que qui dans pour pas sur est au avec par plus ce "
    "el los las del y en por con para una su se lo como más al no es".split()
)
FEATURES = [
    "characters", "words", "word_length", "distinct_words", "most_frequent_word", "word_after_itself", "alphabetic_words",
    "capital_words", "function_words", "lines", "line_length", "repeated_lines", "letters", "capitals", "digits",
    "white_space", "full_stops", "commas", "marks", "other_punctuation", "beyond_ascii", "compressed", "longest_word",
]
_CLASSES = np.full(256, 9, np.uint8)  # 9: other punctuation and control characters
for _k, _bytes in enumerate([
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".?", b",;:", b"#$%&*!|@^~<>{}[]_=+\\/",
]):
    _CLASSES[list(_bytes)] = _k
_CLASSES[128:192] = 10  # inside a character
_CLASSES[192:] = 8


def describe(text: str) -> list[float]:
    """The numbers of one text, in the order of FEATURES."""
    raw = text.encode()
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=11) if raw else np.zeros(11, int)
    n = max(len(text), 1)
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line]
    lower, upper, digit, blank, newline, stop, comma, mark, beyond, other = (kinds[:10] / n).tolist()
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / w, len(counts) / w,
        max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, sum(map(str.isalpha, words)) / w,
        sum(map(str.isupper, words)) / w, sum(c for word, c in counts.items() if word in FUNCTION_WORDS) / w,
        np.log1p(len(lines)), np.log1p(len(text) / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
        lower, upper, digit, blank + newline, stop, comma, mark, other, beyond,
        len(zlib.compress(raw, 1)) / max(len(raw), 1), np.log1p(max(map(len, words), default=0)),
    ]


def describe_all(texts: list[str | None]) -> np.ndarray:
    return np.array([describe(text or "") for text in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Bin edges and tables; a few thousand numbers whatever the size of the corpus."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]  # for each feature: its bin -> its bin in pair tables
    pair_tables: list[np.ndarray]

    def bins(self, numbers: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, numbers[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, numbers: np.ndarray) -> np.ndarray:
        total = np.full(len(numbers), self.start)
        if self.tables:
            bins = self.bins(numbers)
            for f, values in enumerate(self.tables):
                total += values[bins[:, f]]
            for (f, g), values in zip(self.pairs, self.pair_tables):
                total += values[self.coarse[f][bins[:, f]], self.coarse[g][bins[:, g]]]
        return 1 / (1 + np.exp(-total))


def _steps(sums: np.ndarray, weights: np.ndarray, counts: np.ndarray, depth: int, least: int) -> np.ndarray:
    """A shallow regression tree over ordered bins: the value of each bin's leaf."""
    leaf = np.full(len(sums), sums.sum() / (weights.sum() + 1.0))
    if depth == 0 or len(sums) < 2:
        return leaf
    s, w, c = sums.cumsum(), weights.cumsum(), counts.cumsum()
    gain = s[:-1] ** 2 / (w[:-1] + 1) + (s[-1] - s[:-1]) ** 2 / (w[-1] - w[:-1] + 1) - s[-1] ** 2 / (w[-1] + 1)
    gain[(c[:-1] < least) | (c[-1] - c[:-1] < least)] = -1
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= 1e-9:
        return leaf
    return np.concatenate([
        _steps(sums[:at], weights[:at], counts[:at], depth - 1, least),
        _steps(sums[at:], weights[at:], counts[at:], depth - 1, least),
    ])


def _quadrants(sums: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way grid into four leaves: its gain and the values of all cells."""
    s, w = sums.cumsum(0).cumsum(1), weights.cumsum(0).cumsum(1)
    a, wa = s[:-1, :-1], w[:-1, :-1]
    b, wb = s[:-1, -1:] - a, w[:-1, -1:] - wa
    c, wc = s[-1:, :-1] - a, w[-1:, :-1] - wa
    d, wd = s[-1, -1] - a - b - c, w[-1, -1] - wa - wb - wc
    gain = sum(x**2 / (y + 1) for x, y in ((a, wa), (b, wb), (c, wc), (d, wd))) - s[-1, -1] ** 2 / (w[-1, -1] + 1)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(sums)
    for rows, cols, x, y in (
        (slice(i + 1), slice(j + 1), a, wa), (slice(i + 1), slice(j + 1, None), b, wb),
        (slice(i + 1, None), slice(j + 1), c, wc), (slice(i + 1, None), slice(j + 1, None), d, wd),
    ):
        out[rows, cols] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j]), out


def fit(
    numbers: np.ndarray, labels: np.ndarray, bins: int = 64, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 40,
    most_pairs: int = 12, rate: float = 0.1, depth: int = 2, least: int = 10,
) -> Model:
    """Cyclic boosting of one-feature trees, then of two-feature trees, with the logistic loss."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), [], [], [], [], [])
    if len(set(labels.tolist())) < 2:
        return model
    for column in numbers.T:
        model.edges.append(np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])))
    held = model.bins(numbers)
    total = np.full(len(labels), model.start)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    sizes = [np.bincount(held[:, f], minlength=len(t)) for f, t in enumerate(model.tables)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for f, values in enumerate(model.tables):
            down, curve = slopes()
            sums = np.bincount(held[:, f], down, len(values))
            step = rate * _steps(sums, np.bincount(held[:, f], curve, len(values)), sizes[f], depth, least)
            values += step
            total += step[held[:, f]]
    model.coarse = [np.arange(len(t)) * pair_bins // len(t) for t in model.tables]
    small = np.stack([c[held[:, f]] for f, c in enumerate(model.coarse)], axis=1)
    down, curve = slopes()

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(small[:, f] * pair_bins + small[:, g], values, pair_bins**2).reshape(pair_bins, pair_bins)

    every = [(f, g) for f in range(len(FEATURES)) for g in range(f)]
    gains = [_quadrants(grid(f, g, down), grid(f, g, curve))[0] for f, g in every]
    model.pairs = [every[k] for k in np.argsort(gains)[::-1][:most_pairs]]
    model.pair_tables = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (f, g), values in zip(model.pairs, model.pair_tables):
            down, curve = slopes()
            step = rate * _quadrants(grid(f, g, down), grid(f, g, curve))[1]
            values += step
            total += step[small[:, f], small[:, g]]
    return model


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are kept for the test; null ids are not among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on labels of rows that are not held out; at most ``rows`` of them, chosen by hash."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            numbers = describe_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(numbers), pa.list_(pa.float64()))], ["quality", "numbers"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded: at most ``rows`` rows
    got = found.select(F.col("quality").cast("double"), "text").mapInArrow(work, "quality double, numbers array<double>").toArrow()
    got = sorted(zip(got.column("numbers").to_pylist(), got.column("quality").to_pylist()))  # the order of rows is chance
    return fit(np.array([n for n, _ in got]).reshape(-1, len(FEATURES)), np.array([float(q > 0) for _, q in got]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = model.score(describe_all(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    return docs.select(key, text).mapInArrow(work, f"key {kind}, score double").withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""

    def scores(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(describe_all(values.tolist())), dtype="float64")

    scored = F.pandas_udf(scores, "double")
    return docs.where(scored(F.coalesce(F.col(text), F.lit(""))) >= least)
