"""Exact copies against SQL, the index across batches, hard rows."""

import duckdb

from boxlore.llm import exact_dedup, queries
from tests.llm.helpers import ODD_TEXTS, SF, docs_of, saved


def test_against_sql(spark, tmp_path):
    for folder in (SF, saved(spark, tmp_path, documents=docs_of(spark, [*ODD_TEXTS, "", " ", "a", None]))):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if folder == SF else '/*.parquet'}')")
        got = queries.op4_exact_dedup(spark, folder)
        want = con.execute(queries.ORACLES["op4_exact_dedup"])
        columns = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
    assert queries.op4_exact_dedup(spark, saved(spark, tmp_path / "e", documents=docs_of(spark, []))).count() == 0


def test_later_batches_meet_the_index(spark, tmp_path):
    index = exact_dedup.open_index(spark, "digests_of_test", f"{tmp_path}/index")
    first = exact_dedup.keep_first(docs_of(spark, ["a", "b", "a"]), index).collect()
    assert {r.doc_id for r in first} == {2, 3}
    later = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs_of(spark, ["a", "c", "c", None], 10), index).collect()}
    assert later == {10: (3, 1, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 1, True)}
    assert spark.table(index).count() == 4
    spark.sql(f"DROP TABLE {index}")  # the files stay, and a new session opens them again
    assert spark.table(exact_dedup.open_index(spark, index, f"{tmp_path}/index")).count() == 4
    spark.sql(f"DROP TABLE {index}")


def test_repeated_rows_null_ids_and_names(spark):
    docs = docs_of(spark, ["a", "b", None]).withColumnsRenamed({"lang": "digest", "source": "id"})
    docs = docs.union(docs).union(docs.limit(1).selectExpr("CAST(NULL AS LONG)", "text", "digest", "id", "n_chars"))
    kept = exact_dedup.keep_first(docs, queries.new_index(spark))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    alone = docs_of(spark, ["z"]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert [r.text for r in exact_dedup.keep_first(alone, queries.new_index(spark)).collect()] == ["z"]


def test_plan_is_native(spark):
    plan = queries.op4_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
