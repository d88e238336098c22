"""Query registry: id -> (Spark plan builder, DuckDB oracle SQL).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the driver
tables (through the fixture views). The oracle text is what the driver runs
in DuckDB; ``None`` marks a query checked by rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelens.plans import fixtures

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query id {name}")
        REGISTRY[name] = (fn, nullsafe_count_if(sql) if sql else sql)
        return fn
    return deco


def nullsafe_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` over only NULL inputs is NULL where Spark's is 0:
    wrap every call as ``coalesce(count_if(...), 0)`` (string literals are skipped)."""
    out, i, n = [], 0, len(sql)
    key = "count_if("
    while i < n:
        if sql.startswith(key, i) and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            j, depth, in_str = i + len(key), 1, False
            while j < n and depth:
                c = sql[j]
                if in_str:
                    if c == "'":
                        if j + 1 < n and sql[j + 1] == "'":
                            j += 1
                        else:
                            in_str = False
                elif c == "'":
                    in_str = True
                elif c == "(":
                    depth += 1
                elif c == ")":
                    depth -= 1
                j += 1
            inner = nullsafe_count_if(sql[i + len(key): j - 1])
            out.append(f"coalesce(count_if({inner}), 0)")
            i = j
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


class Views:
    """Accessor for the registered driver tables and fixture views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        fixtures.register(spark, sf_dir)
        self.spark = spark

    def __call__(self, name: str) -> DataFrame:
        return self.spark.table(name)


def sql_str(s: str) -> str:
    """SQL string literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return ", ".join(sql_str(x) for x in items)


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # importing the modules fills REGISTRY
    from codelens.plans import (  # noqa: F401
        q_analysis, q_diagnostics, q_deps, q_snapshots, q_streams, q_project, q_investigation, q_suggest,
        q_topology, q_overview, q_misc, q_extra,
    )
    return REGISTRY
