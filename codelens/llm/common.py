"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and go on from those files.

    Cuts the lineage, so what follows neither computes the input again for each
    of its branches nor loses it with an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs that write a table inside this block leave no shuffle files behind: the table replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only (``lower`` would fold every script)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_for(rows: int, per_part: int, at_least: int = 1) -> int:
    """How many partitions or buckets hold ``rows`` at about ``per_part`` rows each."""
    return max(at_least, -(-rows // per_part))


def add_columns(df: DataFrame, inputs: Sequence[str], compute: Callable[..., list[pa.Array]], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """``df`` and further columns made from Arrow arrays of ``inputs``, batch by batch.

    All columns pass through by place, so their names may be anything; a new
    field replaces a column of the same name.
    """
    at = [df.columns.index(c) for c in inputs]
    kept = [i for i, c in enumerate(df.columns) if c not in {n for n, _ in fields}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(*[batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + list(made), names=[f"c{i}" for i in kept] + [f"n{i}" for i in range(len(made))])

    types = [f"c{i} {df.schema[i].dataType.simpleString()}" for i in kept] + [f"n{i} {kind}" for i, (_, kind) in enumerate(fields)]
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, ", ".join(types))
    return out.toDF(*[df.columns[i] for i in kept], *[n for n, _ in fields])


def keep_where(df: DataFrame, decide: Callable[[DataFrame, str, str], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``decide`` keeps, with the columns of ``df``.

    ``decide(rows, key, text)`` sees the columns as k0, k1, ... and gets the
    names that the key and the text have there, so no column of the input can
    clash with what it adds.
    """
    names = [f"k{i}" for i in range(len(df.columns))]
    kept = decide(df.toDF(*names), names[df.columns.index(key)], names[df.columns.index(text)])
    return kept.select(*names).toDF(*df.columns)
