"""Mixing sources to target weights by subset-sum budget fitting.

Targets. Sources in code-point order (null last) get the weights in turn and
share the total size by weight. A target stops at ``times`` the source's size;
the excess goes to the other sources by weight. The sources that stop are those
with the smallest ratio of limit to weight, so prefix sums in that order give the
end of this resharing without repeating it.

Fitting. A source takes all its documents as often as its budget allows in
whole. For the rest only the counts of documents by exact size matter: each size
gets its share of the rest, the longest sizes that still fit fill most of what
rounding left, and a bounded-knapsack table over the last ``KNAPSACK`` words
finds the counts that come nearest. Of the documents of one size those with the
smallest seeded hash are taken.

Scale. Documents move as (id, source, size). Sizes of a source are few (n
different sizes have a sum of at least n * n / 2), so one task holds the counts
of one source. Documents of one size are chosen by counts of hash ranges; only
the documents of one range of one size are sorted together. There is one row a
source where targets are computed.

Defined results: rows equal in id, source and size are interchangeable, counted
as one row and written out again; many of them count as several pieces of at
most ``PIECE`` rows; a null id is an id like others; a null source is a source
of its own (beside the empty string); documents of size 0 are taken 0 times in
words and keep their rows; an empty table gives no rows; results do not depend
on the order or the partitions of the input; other columns of the input are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelens.llm.common import cut, table, text_or_empty

WEIGHTS = (1, 2, 3)
TIMES = 3
SEED = 42
#: Largest remaining budget that the knapsack table spans (it has twice as many places).
KNAPSACK = 1 << 18
#: Alike rows that are chosen together.
PIECE = 1000
#: Rows of one size and one hash range that are sorted together, at small tables; grows with the square root of the rows.
RANGE_ROWS = 20_000

_CLASS = ["no_source", "source", "size"]


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """(no_source, source, source_size) with the target of each source."""
    in_turn = Window.orderBy("no_source", "source")
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_turn) - 1) % len(weights) + 1).cast("long")
    rows = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * times)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_ratio), zero)
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), zero)
    rows = rows.withColumn("stops", F.col("most") * rest_weight <= rest * F.col("weight"))
    free = F.when(~F.col("stops"), F.col("weight"))
    level = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), zero)
    shared = level.cast("double") * F.col("weight") / F.sum(free).over(everything)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(shared)
    return rows.select("no_source", "source", "source_size", target.alias("target"))


def nearest(sizes: np.ndarray, free: np.ndarray, want: int) -> np.ndarray:
    """How many of each size, at most ``free``, sum up nearest to ``want`` (of two equally near sums the smaller).

    Bounded knapsack by doubling multiplicities; for each sum the table keeps
    the step that reached it first, which is the way back.
    """
    top = 2 * want
    step_of = np.full(top + 1, -1, np.int32)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    steps: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        if reached[want]:
            break
        left, many = min(int(free[i]), top // int(sizes[i])), 1
        while left and not reached[want]:
            k = min(many, left)
            w = k * int(sizes[i])
            new = reached[:-w] & ~reached[w:]
            step_of[w:][new] = len(steps)
            reached[w:] |= new
            steps.append((int(i), k))
            left, many = left - k, many * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - want))])
    out = np.zeros(len(sizes), np.int64)
    while at:
        i, k = steps[step_of[at]]
        out[i] += k
        at -= k * int(sizes[i])
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> tuple[int, np.ndarray]:
    """(times that all documents are taken, further documents of each size) for a budget of words."""
    total = int((sizes * counts).sum())
    extra = np.zeros(len(sizes), np.int64)
    if not total:
        return 0, extra
    times, rest = divmod(budget, total)
    if not rest:
        return times, extra
    some = sizes > 0
    room = min(int(sizes.max()), KNAPSACK // 4)  # left for the knapsack, so that it has sums to choose from
    extra[some] = np.floor(counts[some] * (max(0, rest - room) / total * (1 - 1e-12))).astype(np.int64)
    rest -= int((extra * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= KNAPSACK:
            break
        if some[i]:
            more = min(int(counts[i] - extra[i]), rest // int(sizes[i]))
            extra[i] += more
            rest -= more * int(sizes[i])
    free = counts - extra
    if rest <= KNAPSACK:
        usable = np.flatnonzero(some & (free > 0) & (sizes <= 2 * rest))
        if len(usable):
            extra[usable] += nearest(sizes[usable], free[usable], rest)
    else:  # only documents longer than the rest are left
        longer = np.flatnonzero(some & (free > 0))
        i = longer[np.argmin(sizes[longer])] if len(longer) else None
        if i is not None and sizes[i] < 2 * rest:
            extra[i] += 1
    return times, extra


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    times, extra = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), math.floor(rows["target"].iloc[0] + 0.5))
    return rows.assign(times=times, extra=extra)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size",
        weights: Sequence[int] = WEIGHTS, times: int = TIMES, seed: int = SEED) -> DataFrame:
    """(key, source, size, source_size, target, copies): how often the mix takes each row of ``docs``."""
    alike = docs.select(
        F.col(key).alias("id"), F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(size).cast("long").alias("size"),
    ).groupBy("id", *_CLASS).agg(F.count("*").alias("rows"))
    pieces = alike.select("id", *_CLASS, "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(PIECE).cast("long"))).alias("from"))
    pieces = cut(pieces.select(
        "id", *_CLASS, "from", F.least(F.col("rows") - F.col("from"), F.lit(PIECE)).alias("rows"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "from"), 1).alias("hash")))
    ranges = math.ceil(math.sqrt(max(1, pieces.count()) / RANGE_ROWS))
    pieces = pieces.withColumn("range", F.shiftright(F.shiftright("hash", 31) * ranges, 32))

    in_range = pieces.groupBy(*_CLASS, "range").agg(F.sum("rows").alias("n"))
    histogram = in_range.groupBy(*_CLASS).agg(F.sum("n").alias("n"))
    sources = histogram.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    planned = histogram.join(targets(sources, weights, times), ["no_source", "source"]).groupBy("no_source", "source").applyInPandas(
        _fit_source, "no_source boolean, source string, size long, n long, source_size long, target double, times long, extra long")
    before = lambda *order: Window.partitionBy(*_CLASS, *order[:-1]).orderBy(*order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    part = lambda most, n, over: F.greatest(F.least(F.col(most) - F.coalesce(F.sum(n).over(over), F.lit(0)), F.col(n)), F.lit(0))
    taken = in_range.join(planned.drop("n"), _CLASS).select(
        *_CLASS, "range", "source_size", "target", "times", part("extra", "n", before(["range"])).alias("extra"))
    chosen = pieces.join(taken, [*_CLASS, "range"]).withColumn("once_more", part("extra", "rows", before("range", ["hash", "id", "from"])))
    return chosen.select(
        F.col("id").alias(key), F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "times", "once_more",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"),
    ).select(key, "source", "size", "source_size", "target", (F.col("times") + (F.col("row") <= F.col("once_more")).cast("long")).alias("copies"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source, sizes in words."""
    words = F.regexp_count(text_or_empty(), F.lit(r"[^ \t-\r]+")).cast("long")
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
