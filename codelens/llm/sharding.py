"""Weighted rendezvous sharding with DataFrame functions only.

Every (key, shard) pair gets a pseudo-random number u in (0, 1) from MD5; the
record goes to the shard with the largest ``-weight / ln(u)``. The score of a
pair does not depend on the other shards, so a new shard only takes records
into itself and a removed shard only gives its own records away; a shard's
expected share is its weight over the sum of weights.

Defined results: a null key counts as the empty string; equal keys always
share a shard (also when a third of all rows carry one key); an empty table
gives an empty table; other columns of the input pass through, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelens.llm.common import cut, parts_for, table, text_or_empty

SHARDS = 16
#: Rows that one slot bucket holds on average (a window of the numbering sorts one bucket of one shard).
ROWS_PER_BUCKET = 20_000


def uniform(key: Column, shard: int) -> Column:
    """52 bits of MD5(key:shard) as a number strictly between 0 and 1."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of one rendezvous score per shard; a weight of 0 closes the shard."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    return F.array(*[F.lit(-float(w)) / F.log(uniform(key, s)) if w else F.lit(-1.0) for s, w in enumerate(weights)])


def argmax(values: Column) -> Column:
    """0-based place of the largest element (the first of equals)."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rendezvous_shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add the shard of each row for weighted shards 0 .. len(weights) - 1."""
    return df.withColumn(out, argmax(scores(F.col(key), weights)))


def dealt(rows: DataFrame, order: Sequence[str], n_rows: int) -> DataFrame:
    """``rows`` with a column bucket: a hash of ``order`` and the row's place in the input, each in as many ways."""
    ways = math.ceil(math.sqrt(parts_for(n_rows, ROWS_PER_BUCKET)))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(ways)) * ways + F.pmod(F.monotonically_increasing_id(), F.lit(ways)))


def with_slots(df: DataFrame, shard: str, order: Sequence[str], n_rows: int, out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, a shard or a key never being sorted in one task.

    Rows are dealt twice, by a hash of ``order`` and by their place in the input,
    so rows equal in ``order`` spread over as many groups as there are hashes
    (the square root of what the rows need). The dealt rows are cut off once, so
    all that follows sees the same groups. A group's first number is the sum of
    the counts of the shard's earlier groups (pre-aggregated), and only the rows
    of one group of one shard are sorted together. All columns of ``df`` stay,
    whatever their names; a column named ``out`` is replaced.
    """
    at = {c: f"k{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*at.values())
    key, by = at[shard], [at[c] for c in order]
    groups = cut(dealt(rows, by, n_rows))
    counts = groups.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(key).alias("of"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(key, "bucket").orderBy(*by)
    placed = groups.withColumn("row", F.row_number().over(inside)).join(first, F.col(key).eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    kept = [c for c in df.columns if c != out]
    return placed.select(*[F.col(at[c]) for c in kept], (F.col("first") + F.col("row") - 1).cast("long")).toDF(*kept, out)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards by doc_id, and the shard each would have with one more."""
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        scores(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("_scores"),
    ).select(
        "doc_id", "size", "text_crc32",
        argmax(F.slice("_scores", 1, SHARDS)).alias("shard"),
        argmax(F.col("_scores")).alias("grown_shard"),
    )
    placed = with_slots(rows, "shard", ["doc_id", "size"], docs.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
