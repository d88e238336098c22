"""Reading the input tables.

A table stored as one large file with one row group is read by a single
task; everything narrow after it (explode, regex rules) would then run on one
core. ``read_table`` spreads such an input over the session's default
parallelism with one round-robin shuffle of the *input rows* (before any
explode). Inputs that already have enough splits -- every table at cluster
scale -- are left untouched, so no shuffle is added there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition on ``key`` (default: the first column, the table's id) when there are too few splits.

    Hashing one id column keeps the repartition deterministic on recompute
    without the local sort round-robin needs, and lets Catalyst still prune the
    other columns below it (the scan reads only what the query uses).
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, F.col(key or df.columns[0]))
    return df


def read_table(spark: SparkSession, path: str, spread_small_splits: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return spread(df) if spread_small_splits else df
