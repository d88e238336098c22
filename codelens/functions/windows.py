"""Ordered-stream helpers that stay correct and parallel when one key is hot.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends every row of a key to
one task; with a key holding a third of all rows that task is the job. These
helpers see each key's positions as a tree: buckets of ``width`` positions,
then nodes of ``FANOUT`` buckets, then nodes of ``FANOUT`` nodes, up to the
``span`` of the positions:

1. per (key, bucket) an aggregate (count, last value) -- partial aggregation,
   and the same again for every level of nodes above,
2. a prefix inside each node, carried down from the top -- no window holds more
   than ``FANOUT`` summaries, however many positions a key has and however far
   apart they lie,
3. a window inside (key, bucket) -- at most ``width`` rows per task group,

and neighbour access (``lag``/``lead``/context) becomes an equi-join on
``(key, index +- k)``, whose keys are unique, so no group is large.
``pos`` must be integral and unique within a key (``dense_index`` orders equal
positions by its ``tiebreak``; they share a bucket). The rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16
#: most summaries of one window below the top node
FANOUT = 1 << 18
#: positions of a key are taken to differ by less than this (microseconds of 140 years); more only fill the top node
WIDE_SPAN = 1 << 52
#: the same for lines of a file or manifest
LINE_SPAN = 1 << 34


def _bucket(pos: str, width: int) -> Column:
    return F.expr(f"floor(`{pos}` / {width}BD)").cast("bigint")


def _before(buckets: DataFrame, keys: list[str], total: Callable[[], Column], running: Callable[[Window], Column],
            joined: Callable[[Column, Column], Column], places: int, fanout: int) -> DataFrame:
    """``(keys, _b, _v)`` summaries -> the same rows with ``_v`` of all earlier buckets of the key (exclusive prefix).

    ``total`` aggregates summaries, ``running`` is that aggregate over a window,
    and ``joined(earlier, later)`` puts two of them together.
    """
    earlier = (Window.unboundedPreceding, -1)
    if places <= fanout:
        whole = Window.partitionBy(*keys).orderBy("_b").rowsBetween(*earlier)
        return buckets.select(*keys, "_b", running(whole).alias("_v"))
    nodes = buckets.withColumn("_up", _bucket("_b", fanout))
    tops = nodes.groupBy(*keys, "_up").agg(total().alias("_v")).withColumnRenamed("_up", "_b")
    carried = _before(tops, keys, total, running, joined, places // fanout, fanout)
    carried = carried.withColumnRenamed("_b", "_up").withColumnRenamed("_v", "_carried")
    node = Window.partitionBy(*keys, "_up").orderBy("_b").rowsBetween(*earlier)
    return (nodes.withColumn("_in", running(node)).join(carried, [*keys, "_up"])
            .select(*keys, "_b", joined(F.col("_carried"), F.col("_in")).alias("_v")))


def _sums_before(buckets: DataFrame, keys: list[str], places: int, fanout: int) -> DataFrame:
    return _before(buckets, keys, lambda: F.sum("_v"), lambda w: F.coalesce(F.sum("_v").over(w), F.lit(0)),
                   lambda earlier, later: earlier + later, places, fanout)


def _last_before(buckets: DataFrame, keys: list[str], places: int, fanout: int) -> DataFrame:
    return _before(buckets, keys, lambda: F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.col("_b"))),
                   lambda w: F.last("_v", ignorenulls=True).over(w),
                   lambda earlier, later: F.coalesce(later, earlier), places, fanout)


def dense_index(df: DataFrame, keys: list[str], pos: str, out: str = "idx", width: int = DEFAULT_WIDTH,
                tiebreak: tuple[str, ...] = (), span: int = WIDE_SPAN, fanout: int = FANOUT) -> DataFrame:
    """1-based row number of each row within ``keys`` ordered by ``pos`` (then ``tiebreak``)."""
    b = df.withColumn("_b", _bucket(pos, width))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_v"))
    offsets = _sums_before(counts, keys, span // width, fanout)
    inside = Window.partitionBy(*keys, "_b").orderBy(pos, *tiebreak)
    return (b.join(offsets, [*keys, "_b"])
            .withColumn(out, (F.col("_v") + F.row_number().over(inside)).cast("bigint"))
            .drop("_b", "_v"))


def prefix_sum(df: DataFrame, keys: list[str], pos: str, value: str, out: str, inclusive: bool = True,
               width: int = DEFAULT_WIDTH, span: int = WIDE_SPAN, fanout: int = FANOUT) -> DataFrame:
    """Running sum of ``value`` within ``keys`` ordered by ``pos`` (bucketed like ``dense_index``)."""
    b = df.withColumn("_b", _bucket(pos, width))
    sums = b.groupBy(*keys, "_b").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_v"))
    offsets = _sums_before(sums, keys, span // width, fanout)
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    return (b.join(offsets, [*keys, "_b"])
            .withColumn(out, (F.col("_v") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("bigint"))
            .drop("_b", "_v"))


def stream_sizes(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Rows per key (partial aggregation, safe for a hot key)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(out))


def ffill(df: DataFrame, keys: list[str], pos: str, value: str, out: str, inclusive: bool = True,
          width: int = DEFAULT_WIDTH, span: int = WIDE_SPAN, fanout: int = FANOUT) -> DataFrame:
    """Last non-null ``value`` at (inclusive) or before the row, within ``keys`` by ``pos``."""
    b = df.withColumn("_b", _bucket(pos, width))
    # one row per (key, bucket): its last non-null value (NULL when it has none)
    per_bucket = b.groupBy(*keys, "_b").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(pos))).alias("_v"))
    carry = _last_before(per_bucket, keys, span // width, fanout)
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    return (b.join(carry, [*keys, "_b"], "left")
            .withColumn(out, F.coalesce(F.last(F.col(value), ignorenulls=True).over(inside), F.col("_v")))
            .drop("_b", "_v"))
