"""The stages one after the other against plain versions of each."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from boxlore.llm import quality
from tests.llm.helpers import docs_of, saved
from tests.llm.test_jaccard_join import brute as similar
from tests.llm.test_substring_dedup import brute as repeated, corpus


def made(spark, tmp_path):
    chance = random.Random(4)
    texts = corpus(4)
    texts += [" ".join(chance.choice(["XX!!", "YY##", "$$$"]) for _ in range(60)) for _ in range(30)]
    texts += [f"{t} tail{k}" for k, t in enumerate(chance.sample([t for t in texts if len(t) > 400], 12))] + [None, None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int("!!" not in (t or "")), 0) for k, t in enumerate(texts, 1)], "doc_id long, quality int, toxic int")
    return dict(enumerate(texts, 1)), saved(spark, tmp_path, documents=docs, labels=labels)


def test_stages(spark, tmp_path):
    texts, folder = made(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        seen.append({r.doc_id: r.text for r in rows})
    first, second, third, fourth = seen

    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(quality.describe_all(list(texts.values())))
    assert first == {k: t for (k, t), s in zip(texts.items(), scores) if s >= 0.7}
    assert 0 < len(texts) - len(first) < 60
    last = {t or "": k for k, t in sorted(first.items())}
    assert second == {k: t for k, t in first.items() if last[t or ""] == k}
    parts = similar(second)
    assert third == {k: t for k, t in second.items() if parts[k][1] == k} and len(third) < len(second)
    want = repeated(third)
    for k, text in fourth.items():
        words, gone, digest = want[k]
        assert gone or text == third[k]
        assert hashlib.sha256(" ".join((text or "").encode().decode().split()).encode()).hexdigest() == digest
    assert fourth.keys() == third.keys()

    library, packed = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for row in corpus_pipeline.STAGES[-1][1](spark, docs, folder).orderBy("doc_id", "start").collect():
        assert row.length == len(row.ids) // 4 and row.length & (row.length - 1) == 0
        packed.setdefault(row.doc_id, []).extend(np.frombuffer(row.ids, "<u4").tolist())
    assert packed == {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in fourth.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id").collect())) == sorted(
        map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, folder).drop("sequence_id").collect()))


def test_empty_tables(spark, tmp_path):
    folder = saved(spark, tmp_path, documents=docs_of(spark, []), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0
