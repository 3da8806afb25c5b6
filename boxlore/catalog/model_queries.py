"""Column discovery, classifiers, topics, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlore.catalog.registry import query, table
from boxlore.catalog.views import logs
from boxlore.functions.text import index_terms, mask_addresses, words
from boxlore.operators import classify, embed, enrich, mutual_info, topics
from boxlore.sources.tables import spread

_COLUMNS = ["category", "directory_file", "dataset", "data"]


def _mi_sql(keys: str, columns: dict[str, str], source: str, label: str) -> str:
    """Mutual information per key and column as SQL over the joint counts."""
    cells = " UNION ALL ".join(
        f"SELECT {keys}'{name}' AS col, {expr} AS val, {label} AS lab FROM {source}" for name, expr in columns.items())
    return f"""long AS ({cells}),
j AS (SELECT {keys}col, val, lab, count(*)::DOUBLE AS n FROM long GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY {keys}col, val) AS nx, sum(n) OVER (PARTITION BY {keys}col, lab) AS ny,
        sum(n) OVER (PARTITION BY {keys}col) AS t FROM j),
mi AS (SELECT {keys}col, sum(n / t * ln(n * t / (nx * ny))) AS mi, count(DISTINCT val) AS nv FROM m GROUP BY {keys}col)"""


_OR_NULL = {c: f"coalesce(nullif({c}, ''), 'NULL')" for c in _COLUMNS}
_UNKNOWN = "coalesce(event_type, 'UNKNOWN')"


@query("mutual_information_per_receiver", f"""
WITH {_mi_sql('rxid, ', _OR_NULL, 'logs', _UNKNOWN)}
SELECT rxid, col AS "column", round(abs(mi), 6) AS mi, nv AS n_values FROM mi""")
def _(spark, sf):
    out = mutual_info.mutual_information(logs(spark, sf), _COLUMNS, mutual_info.label_or_unknown(), ["rxid"])
    return out.select("rxid", "column", F.round("mi", 6).alias("mi"), "n_values")


_RANKED = f"""{_mi_sql('rxid, ', {**_OR_NULL, 'event_type': _UNKNOWN.replace('UNKNOWN', 'NULL')}, 'logs', _UNKNOWN)},
r AS (SELECT *, row_number() OVER (PARTITION BY rxid ORDER BY round(abs(mi), 9) DESC, col) AS place FROM mi)"""


@query("relevant_columns", f"""WITH {_RANKED} SELECT rxid, col AS "column" FROM r WHERE place <= 3 OR col = 'event_type'""")
def _(spark, sf):
    return mutual_info.relevant_columns(logs(spark, sf), _COLUMNS)


@query("relevant_columns_of_any", f"""WITH {_RANKED} SELECT DISTINCT col AS "column" FROM r WHERE place <= 3 OR col = 'event_type'""")
def _(spark, sf):
    return mutual_info.columns_of_any(mutual_info.relevant_columns(logs(spark, sf), _COLUMNS))


@query("relevant_columns_hybrid", f"""
WITH {_RANKED.replace("'event_type' AS col", "'zz' AS col")},
b AS (SELECT col, row_number() OVER (PARTITION BY rxid ORDER BY round(abs(mi), 9) DESC, col) AS p FROM mi WHERE col <> 'zz')
SELECT DISTINCT col AS "column" FROM b WHERE p <= 2 UNION SELECT unnest(['event_type', 'svc_name', 'video_resolution', 'connection_status',
  'category', 'file_line', 'function', 'timestamp', 'rx_id', 'software', 'model', 'data', 'info', 'details'])""")
def _(spark, sf):
    return mutual_info.hybrid_columns(logs(spark, sf), [*_COLUMNS, "event_type"], k=2)


_GLOBAL = f"""l AS (SELECT *, CASE WHEN kind = 0 THEN NULL ELSE directory_file END AS f FROM logs WHERE event_type IS NOT NULL),
{_mi_sql('', {'category': 'category', 'f': "coalesce(f, 'None')", 'data': 'data', 'one': "'x'"}, 'l', 'event_type')}"""


def _global(spark, sf):
    df = logs(spark, sf).withColumns({"f": F.when(F.col("kind") != 0, F.col("directory_file")), "one": F.lit("x")})
    return mutual_info.global_scores(df, ["category", "f", "data", "one"])


@query("global_column_scores", f"""
WITH {_GLOBAL} SELECT col AS "column", round(CASE WHEN nv <= 1 THEN 0 ELSE abs(mi) END, 6) AS mi FROM mi""")
def _(spark, sf):
    return _global(spark, sf).select("column", F.round("mi", 6).alias("mi"))


@query("props_mutual_information", f"""
WITH {_mi_sql('', {'props': 'props'}, 'events', 'event_type')} SELECT round(mi, 9) AS mi FROM mi""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return mutual_info.mutual_information(e, ["props"], F.col("event_type")).select(F.round("mi", 9).alias("mi"))


def _history(spark):
    """How often each column scored low in the runs before."""
    return spark.createDataFrame([("one", 9), ("f", 4), ("gone", 2)], "column string, low_runs int")


@query("refined_columns", f"""
WITH {_GLOBAL}, s AS (SELECT col, CASE WHEN nv <= 1 THEN 0 ELSE abs(mi) END AS mi FROM mi)
SELECT col AS "column" FROM s WHERE mi >= 0.0001 AND col <> 'one' UNION SELECT 'event_type'""")
def _(spark, sf):
    kept, _ = mutual_info.refine_columns(_global(spark, sf), _history(spark))
    return kept.select("column")


@query("refined_column_history", f"""
WITH {_GLOBAL}, s AS (SELECT col, CASE WHEN nv <= 1 THEN 0 ELSE abs(mi) END AS mi FROM mi)
SELECT col AS "column", CAST(CASE WHEN mi < 0.0001 THEN CASE col WHEN 'one' THEN 10 WHEN 'f' THEN 5 ELSE 1 END ELSE 0 END AS INTEGER) AS low_runs FROM s
UNION ALL SELECT 'gone', 2""")
def _(spark, sf):
    return mutual_info.refine_columns(_global(spark, sf), _history(spark))[1]


@query("feature_text_and_label", """
SELECT id, coalesce(category, '') || ' ' || coalesce(CASE WHEN kind <> 2 THEN data END, '')
  || CASE kind WHEN 1 THEN ' Not Connected' WHEN 2 THEN ' Connected' WHEN 18 THEN ' HBO-' || CAST(u AS VARCHAR) || ' '
     || CAST(1000 + u % 9000 AS VARCHAR) || 'x1080' WHEN 19 THEN ' ' || CAST(1000 + u % 9000 AS VARCHAR) || 'x720' ELSE '' END AS text,
  CASE WHEN kind = 3 THEN 'UNKNOWN' WHEN kind = 4 THEN category ELSE coalesce(event_type, category) END AS label
FROM logs""")
def _(spark, sf):
    from boxlore.functions.message_fields import extract_fields

    k = F.col("kind")
    df = extract_fields(logs(spark, sf), only=["svc_name", "video_resolution", "connection_status"])
    df = df.withColumn("body", F.when(k != 2, F.col("data")))
    df = df.withColumn("text", enrich.feature_text(["category", "body"]))
    df = df.withColumns({
        "event_type": F.when(k == 3, " ").when(k == 4, F.lit(None)).otherwise(F.col("event_type")),
        "category": F.when(k != 3, F.col("category")),
    })
    return df.select("id", "text", enrich.label().alias("label"))


_TERMS = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"""


@query("term_counts", f"WITH {_TERMS} SELECT doc_id, term, tf FROM c")
def _(spark, sf):
    return classify.term_counts(spread(table(spark, sf, "documents")), "doc_id", F.col("text"))


@query("tfidf_weights", f"""
WITH {_TERMS}, v AS (SELECT term, count(*) AS df FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM c JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def _(spark, sf):
    out = classify.tfidf_terms(spread(table(spark, sf, "documents")), "doc_id", F.col("text"), 1000)
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("training_rows_of_all", """
SELECT data, category, event_type FROM logs WHERE event_type IS NOT NULL""")
def _(spark, sf):
    return classify.training_rows_or_all(logs(spark, sf), ["data"]).select("data", "category", "event_type")


@query("column_kinds", """
SELECT 'metric_num' AS "column", count(metric_num) AS filled, count(metric_num) AS numeric, 'numeric' AS kind FROM logs
UNION ALL SELECT 'category', count(*), 0, 'categorical' FROM logs
UNION ALL SELECT 'mixed', count(*) FILTER (kind < 2), count(*) FILTER (kind = 0), 'categorical' FROM logs
UNION ALL SELECT 'digits', count(*) FILTER (kind = 0), count(*) FILTER (kind = 0), 'numeric' FROM logs""")
def _(spark, sf):
    k = F.col("kind")
    df = logs(spark, sf).withColumns({
        "mixed": F.when(k == 0, "12").when(k == 1, "x").otherwise(""), "digits": F.when(k == 0, "7"),
    })
    return classify.column_kinds(df, ["metric_num", "category", "mixed", "digits"])


def _labelled(spark, sf):
    return enrich.rule_labels(logs(spark, sf, spread_out=True))


@query("forest_labels")
def _(spark, sf):
    df = _labelled(spark, sf)
    model = classify.fit_text_classifier(classify.training_rows(df, ["data"]), ["data"], max_features=500, trees=10, depth=5)
    out = enrich.enrich(logs(spark, sf, spread_out=True), lambda rows: classify.predict_labels(model, rows, ["data"]))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("bayes_labels")
def _(spark, sf):
    df = _labelled(spark, sf)
    model = classify.fit_text_classifier(df.where("event_type IS NOT NULL"), ["data"], "NaiveBayes", 500, counts_only=True)
    return classify.predict_labels(model, df, ["data"]).groupBy("predicted").agg(F.count("*").alias("n"))


@query("forest_importances")
def _(spark, sf):
    model = classify.fit_text_classifier(
        _labelled(spark, sf).where("event_type IS NOT NULL"), ["data"], max_features=500, trees=10, depth=5, counts_only=True)
    return spark.createDataFrame(classify.feature_importances(model, 20), "term string, importance double")


@query("hybrid_labels")
def _(spark, sf):
    df = _labelled(spark, sf)
    model, roles = classify.fit_hybrid(
        df.where("event_type IS NOT NULL"), ["data", "category", "svc_name", "timestamp"], max_features=200, axes=10, trees=10, depth=5)
    return classify.predict_hybrid(model, roles, df).groupBy("predicted").agg(F.count("*").alias("n"))


@query("masked_addresses", r"""
SELECT doc_id, regexp_replace(regexp_replace(text,
  '\b([0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2})\b',
  'MAC_ADDRESS_\1', 'g'), '\b(\d{1,3}(?:\.\d{1,3}){3})\b', 'IP_ADDRESS_\1 \1', 'g') AS text FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mask_addresses(F.col("text")).alias("text"))


@query("message_words", """
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}_]+'),
  lambda w: length(w) BETWEEN 2 AND 15 AND NOT starts_with(w, '_')), ' ') AS words FROM documents""")
def _(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.array_join(words(F.col("text")), " ").alias("words"))


@query("labelled_message_words", """
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'module nal timestamp fileline src message hello world'
  ELSE 'message addr ip_address_ mac_address_ff' END AS words FROM events""")
def _(spark, sf):
    n = (F.col("event_id") % 200).cast("string")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[nal]<01/15><src:"), n, F.lit("> hello world"))).otherwise(
        F.concat(F.lit("addr 10.0.0."), n, F.lit(" ff:11:22:33:44:55")))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array_join(topics.message_words(line), " ").alias("words"))


def _tokens(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return d.select(F.col("doc_id").alias("id"), "source", topics.message_words(F.col("text")).alias("tokens"))


_WORDS = """w AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower('[MESSAGE] ' || text)), '[\\p{L}_]+'),
  lambda w: length(w) BETWEEN 2 AND 15 AND NOT starts_with(w, '_')) AS tokens FROM documents)"""


@query("topic_vocabulary_size", f"""
WITH {_WORDS.replace("'[MESSAGE] ' || text", "text")} SELECT count(DISTINCT t) AS n FROM (SELECT unnest(tokens) AS t FROM w)""")
def _(spark, sf):
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), words(F.col("text")).alias("tokens"))
    return topics.vocabulary(d).agg(F.count("*").alias("n"))


@query("prefixed_messages", "SELECT doc_id, '[' || source || '/' || lang || '.log] ' || text AS message FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/logs/"), "source", F.lit("/"), "lang", F.lit(".log"))
    return d.select("doc_id", topics.prefixed(path, F.col("text"), "/logs/").alias("message"))


_TOPICS = {0: ["the", "and", "of", "are"], 1: ["le", "de", "la", "les"], 2: ["the", "le", "der", "zzzz"]}


@query("topic_coherence", f"""
WITH {_WORDS}, d AS (SELECT doc_id, list_distinct(tokens) AS tokens FROM w), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
g AS (SELECT * FROM (VALUES {', '.join(f"({t}, '{a}', '{b}')" for t, ns in _TOPICS.items() for i, a in enumerate(ns) for b in ns[i + 1:])}) v(topic, a, b)),
f AS (SELECT topic, a, b, (SELECT count(*) FROM d WHERE list_contains(tokens, a)) AS na, (SELECT count(*) FROM d WHERE list_contains(tokens, b)) AS nb,
  (SELECT count(*) FROM d WHERE list_contains(tokens, a) AND list_contains(tokens, b)) AS nab FROM g)
SELECT CAST(topic AS INTEGER) AS topic, round(avg(CASE WHEN nab = 0 THEN -1 WHEN nab = n THEN 1 ELSE ln(nab * n / (na * nb)) / -ln(nab / n) END), 6) AS coherence
FROM f, n GROUP BY topic""")
def _(spark, sf):
    out = topics.coherence(_tokens(spark, sf), _TOPICS)
    return out.select("topic", F.round("coherence", 6).alias("coherence"))


@query("topic_overview")
def _(spark, sf):
    return topics.topic_overview(topics.fit_topics(_tokens(spark, sf), 5, vocabulary_size=2000, iterations=3))


@query("embedding_norms", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(embed.norm(F.col("embedding")), 6).alias("norm"))


@query("source_codes", """
SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents""")
def _(spark, sf):
    from boxlore.plans.groups import dense_codes

    d = table(spark, sf, "documents")
    return d.join(dense_codes(d, "source", prefix=4), "source").select("doc_id", "code")


def _embedded(spark, sf):
    df = logs(spark, sf).withColumn("source_table", F.col("rxid"))
    return df, df.where("u % 3 <> 0 AND id % 2 = 0").where(F.dayofmonth("timestamp") <= 15)


_EMBEDDED = """e AS (SELECT rxid, max("timestamp") AS mark FROM logs WHERE u % 3 <> 0 AND id % 2 = 0 AND day("timestamp") <= 15 GROUP BY rxid)"""


@query("new_and_known_sources", f"""
WITH {_EMBEDDED} SELECT DISTINCT rxid AS source_table, rxid NOT IN (SELECT rxid FROM e) AS is_new FROM logs""")
def _(spark, sf):
    new, known = embed.split_sources(*_embedded(spark, sf))
    return new.withColumn("is_new", F.lit(True)).union(known.withColumn("is_new", F.lit(False)))


@query("rows_after_high_water_mark", f"""
WITH {_EMBEDDED} SELECT l.id FROM logs l LEFT JOIN e ON e.rxid = l.rxid WHERE mark IS NULL OR l."timestamp" > mark""")
def _(spark, sf):
    return embed.newer_rows(*_embedded(spark, sf)).select("id")


@query("imputed_timestamps", """
SELECT id, CASE WHEN kind = 2 THEN 1700000000000000 ELSE epoch_us("timestamp") END AS us, kind = 2 AS timestamp_imputed FROM logs""")
def _(spark, sf):
    df = logs(spark, sf).withColumn("timestamp", F.when(F.col("kind") != 2, F.col("timestamp")))
    out = embed.with_timestamps(df, F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    return out.select("id", F.unix_micros("timestamp").alias("us"), "timestamp_imputed")


@query("message_embeddings")
def _(spark, sf):
    df = logs(spark, sf, spread_out=True).withColumn("source_table", F.col("rxid"))
    out = embed.embed_with_words(embed.fit_words(df, 16), df)
    return embed.landscape(out).select("id", "source_code", F.size("embedding").alias("dims"), "norm")
