"""Join helpers with explicit size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a side is broadcast only when it has at most this many rows (checked, not assumed)
BROADCAST_MAX_ROWS = 200_000

# proofs already made in this process: (session id, plan hash, input files, bound) -> small?
_CHECKED: dict[tuple[int, int, int, int], bool] = {}


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Bounded proof that ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1 rows).

    The answer is kept for the session, the same analysed plan and the same
    input files, so a table that has grown is checked again.
    """
    key = (id(df.sparkSession), df.semanticHash(), hash(tuple(df.inputFiles())), max_rows)
    if key not in _CHECKED:
        _CHECKED[key] = df.limit(max_rows + 1).count() <= max_rows
    return _CHECKED[key]


def forget_size_checks() -> None:
    _CHECKED.clear()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` when a bounded count proves it small; else leave it to a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def fixed_dim(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension built from a fixed literal list: its size is known, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))
