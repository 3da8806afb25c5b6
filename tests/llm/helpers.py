"""Small tables with the hard cases, and the rows of a query by key."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=1):
    """A documents table with these texts (some may be null), ids counting up."""
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


def saved(spark, tmp_path, **tables):
    """A folder of Parquet tables for a query to read."""
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def by(df, *keys):
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        assert key not in out, key
        out[key if len(keys) > 1 else key[0]] = row
    return out


ODD_TEXTS = [
    None, "", " ", "a", "a  b", "x\n\n y ", "don't I'll", "<|endoftext|>", "a<|endoftext|> b", "日本語 テスト", "🙂🙂 x",
    "one two three four five six", "one two three four five six", "y" * 30000, "\x1c a \x85b", "word " * 3000, "é́ e", "\t",
]

__all__ = ["DOCS", "ODD_TEXTS", "SF", "T", "by", "docs_of", "saved"]
