"""Small tables with the cases that every operator must take, and helpers to compare with brute force."""

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators might use for themselves.
CLASHING = ["key", "k0", "c0", "n0", "fp", "score", "spans", "n_words", "item_ids", "sha256", "first", "_bucket", "_key", "shard", "slot", "length", "hash"]


def docs(spark, texts, ids=None, extra=False):
    rows = [(ids[i] if ids else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING}) if extra else df


def rows(df):
    """Rows as a sorted list of tuples, nulls and mixed types included."""
    return sorted(map(tuple, df.collect()), key=repr)
