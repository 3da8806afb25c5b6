"""The additive model: held-out accuracy, folds, hard cases."""

import zlib

import numpy as np

from boxlore.llm import quality, queries
from tests.llm.helpers import ODD_TEXTS, by, docs_of, saved


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = by(queries.op10_quality(spark, folder), "doc_id")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for key, row in got.items():
        assert row.held_out == (zlib.crc32(str(key).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
    tested = [(labels[k], r.predicted) for k, r in got.items() if r.held_out and k in labels]
    good = [p for q, p in tested if q == 1]
    bad = [p for q, p in tested if q == 0]
    assert len(bad) > 50
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1, (np.mean(good), np.mean(bad))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_texts_and_labels(spark, tmp_path):
    docs = docs_of(spark, ODD_TEXTS + [f"Plain words follow each other here, number {k}." for k in range(40)])
    labels = [(k, int(k > len(ODD_TEXTS)), 0) for k in range(1, len(ODD_TEXTS) + 30)]
    folder = saved(spark, tmp_path, documents=docs, labels=labels_of(spark, [*labels, (None, 1, 0), (1, None, 0), (9999, 0, 0)]))
    rows = queries.op10_quality(spark, folder).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_no_labels_and_no_rows(spark, tmp_path):
    folder = saved(spark, tmp_path, documents=docs_of(spark, ["a", None]), labels=labels_of(spark, []))
    assert [r.score for r in queries.op10_quality(spark, folder).collect()] == [0.5, 0.5]
    folder = saved(spark, tmp_path / "none", documents=docs_of(spark, []), labels=labels_of(spark, [(1, 1, 0)]))
    assert queries.op10_quality(spark, folder).count() == 0


def test_interaction_is_learned():
    chance = np.random.default_rng(0)
    numbers = chance.random((4000, len(quality.FEATURES)))
    labels = ((numbers[:, 2] > 0.5) ^ (numbers[:, 7] > 0.5)).astype(float)
    model = quality.fit(numbers, labels)
    assert model.pairs[0] == (7, 2)
    assert ((model.score(numbers) > 0.5) == labels).mean() > 0.95


def test_accepted_keeps_columns_and_repeated_rows(spark):
    docs = docs_of(spark, ["a b", "a b", None])
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    kept = quality.accepted(docs.withColumnRenamed("lang", "score"), model, least=0.4)
    assert kept.columns == ["doc_id", "text", "score", "source", "n_chars"] and kept.count() == 3
