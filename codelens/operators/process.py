"""Process output and file-change windows (batch form; streaming twins in codelens.streaming).

Per-stream order is by ``seq``. Positions inside a stream come from the
bucketed ``dense_index`` and neighbours are reached by equi-joins on the
position, so a process that writes a third of all lines is still spread over
many tasks. Latest-per-key is ``max_by`` (partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.windows import dense_index, stream_sizes
from codelens.operators.diagnostics import classify_process_lines


def with_context(lines: DataFrame, keys=("pid", "source"), pos: str = "seq", n: int = C.CONTEXT_LINES,
                 errors: DataFrame | None = None) -> DataFrame:
    """WIN_CONTEXT: each error line with the last ``n`` lines of its stream up to and including it."""
    keys = list(keys)
    indexed = dense_index(lines, keys, pos, out="_i")
    errs = classify_process_lines(indexed) if errors is None else errors
    carried = [pos, "severity", "error_type", "message"]
    # each error names the positions of its context lines; the error's own columns ride along,
    # so one join and one (bounded, <= n rows) group give the result
    wanted = errs.select(*keys, *carried,
                         F.explode(F.sequence(F.greatest(F.lit(1).cast("bigint"), F.col("_i") - (n - 1)),
                                              F.col("_i"))).alias("_i"))
    ctx = wanted.join(indexed.select(*keys, "_i", F.col("line").alias("_ctx")), [*keys, "_i"])
    return (ctx.groupBy(*keys, *carried).agg(F.sort_array(F.collect_list(F.struct("_i", "_ctx"))).alias("_c"))
            .withColumn("context", F.transform("_c", lambda x: x["_ctx"]))
            .drop("_c"))


def tail(lines: DataFrame, keys=("pid",), pos: str = "seq", n: int = C.DEFAULT_TAIL) -> DataFrame:
    """WIN_TAIL / WIN_RETAIN: the last ``n`` rows of each stream (n <= 0 keeps all)."""
    keys = list(keys)
    if n <= 0:
        return lines.withColumn("from_end", F.lit(None).cast("bigint"))
    indexed = dense_index(lines, keys, pos, out="_i")
    sizes = stream_sizes(lines, keys, out="_n")
    return (indexed.join(sizes, keys)
            .where(F.col("_i") > F.col("_n") - n)
            .withColumn("from_end", (F.col("_n") - F.col("_i") + 1).cast("bigint"))
            .drop("_i", "_n"))


def latest_per_key(df: DataFrame, keys, pos: str = "seq") -> DataFrame:
    """Newest row per key (max_by over a struct of all columns)."""
    keys = list(keys)
    cols = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(pos)).alias("_r"))
            .select(*keys, "_r.*"))


def latest_errors(errors: DataFrame, since_minutes: int = 5, ts: str = "ts", key: str = "pid",
                  as_of: Column | None = None) -> DataFrame:
    """WIN_LAST_ERROR / STR_LATEST: last error per process if newer than ``as_of - since``.

    ``as_of`` defaults to the newest event time of the input (a scalar subquery).
    """
    last = latest_per_key(errors, [key])
    ref = as_of if as_of is not None else errors.select(F.max(ts)).scalar()
    # strictly after the cut-off, as the source tool compares
    return last.where(F.col(ts) > ref - F.expr(f"INTERVAL {int(since_minutes)} MINUTES"))


_DURATION_PART = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|\u00b5s|\u03bcs|ms|s|m|h)"
# minutes in one unit of a duration
_UNIT_MINUTES = {"ns": 1 / 6e10, "us": 1 / 6e7, "\u00b5s": 1 / 6e7, "\u03bcs": 1 / 6e7, "ms": 1 / 6e4, "s": 1 / 60, "m": 1.0, "h": 60.0}


def parse_duration_minutes(text: Column, default_minutes: int = 5) -> Column:
    """Duration text (signed sums of decimals with a unit: '90s', '1h30m', '1.5h', '-2m', '0') -> minutes; bad text -> default."""
    valid = text.rlike(rf"^[+-]?(?:0|(?:{_DURATION_PART})+)$")
    amounts = F.regexp_extract_all(text, F.lit(_DURATION_PART), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_DURATION_PART), F.lit(2))
    scale = F.create_map(*[F.lit(x) for kv in _UNIT_MINUTES.items() for x in kv])
    terms = F.zip_with(amounts, units, lambda a, u: a.cast("double") * F.try_element_at(scale, u))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(valid, signed).otherwise(F.lit(float(default_minutes)))


def file_changes(observations: DataFrame, key: str = "path", pos: str = "seq") -> DataFrame:
    """WIN_CHANGES: first sight of a path = created; mtime newer than the previous poll = modified."""
    indexed = dense_index(observations, [key], pos, out="_i")
    prev = indexed.select(key, (F.col("_i") + 1).alias("_i"), F.col("mtime").alias("_prev_mtime"))
    j = indexed.join(prev, [key, "_i"], "left")
    ctype = (F.when(F.col("_i") == 1, "created")
             .when(F.col("mtime") > F.col("_prev_mtime"), "modified"))
    return (j.withColumn("change_type", ctype).where(F.col("change_type").isNotNull())
            .drop("_i", "_prev_mtime"))


def top_k(df: DataFrame, keys, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group by ``order`` (adds ``rank``), safe for a hot group.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so each map task forwards at most ``k`` rows per group; with
    no group it is a distributed TakeOrderedAndProject.
    """
    keys = list(keys)
    if not keys:
        w = Window.orderBy(*order)
        return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(w).cast("bigint"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def change_project(path: Column) -> Column:
    """The workspace that an observed path belongs to: its first element."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def recent_changes(changes: DataFrame, as_of: Column | None = None, keep: int = C.MAX_CHANGES,
                   minutes: int = 10, ts: str = "observed_at", keys=("project",)) -> DataFrame:
    """STR_RECENT (batch): of each workspace the newest ``keep`` changes, then those within ``minutes`` of ``as_of``."""
    changes = changes if "project" in changes.columns else changes.withColumn("project", change_project(F.col("path")))
    capped = top_k(changes, keys, [F.col(ts).desc(), F.col("seq").desc()], keep)
    ref = as_of if as_of is not None else changes.select(F.max(ts)).scalar()
    return capped.where(F.col(ts) > ref - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
