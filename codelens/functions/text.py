"""Column helpers for text, paths and regexes (all JVM-side expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[\\t\\n\\f\\r ]"  # RE2's \s (no vertical tab), used on both engines


def java_regex(pattern: str) -> str:
    """Make a RE2 pattern behave the same under java.util.regex.

    ``(?d)``: only ``\\n`` ends a line, so ``.`` matches ``\\r`` as in RE2.
    ``(?i)`` becomes ``(?iu)`` (Unicode case folding, as RE2 does).
    ``\\s`` becomes RE2's class (Java's includes the vertical tab).
    """
    p = pattern.replace("(?i)", "(?iu)").replace("(?i:", "(?iu:")
    p = p.replace("\\s", WS)
    return "(?d)" + p


def scoped(pattern: str) -> str:
    """Wrap a pattern so a leading inline flag only covers it inside an alternation."""
    m = re.match(r"^\(\?([a-z]+)\)(.*)$", pattern, re.S)
    if m:
        return f"(?{m.group(1)}:{m.group(2)})"
    return f"(?:{pattern})"


def any_of(patterns) -> str:
    """One alternation that matches when any pattern matches (unanchored)."""
    return "|".join(scoped(p) for p in patterns)


def rlike(col: Column, pattern: str) -> Column:
    return col.rlike(java_regex(pattern))


def extract(col: Column, pattern: str, idx: int = 1) -> Column:
    """First-match group, NULL when the pattern does not match (like FindStringSubmatch)."""
    jp = java_regex(pattern)
    return F.when(col.rlike(jp), F.regexp_extract(col, jp, idx))


def trim_ws(col: Column) -> Column:
    """Trim white space on both ends (Go TrimSpace on ASCII white space)."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def fields(col: Column) -> Column:
    """Go strings.Fields: split on runs of white space, no empty items."""
    return F.split(trim_ws(col), f"{WS}+")


def file_ext(path: Column) -> Column:
    """Lower-cased extension of the last path element ('' if none)."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def count_substr(col: Column, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    return F.when(F.lit(len(sub)) == 0, F.lit(0)).otherwise(
        (F.length(col) - F.length(F.replace(col, F.lit(sub), F.lit("")))) / F.lit(len(sub))
    ).cast("bigint")


def map_lookup(mapping: dict, key: Column, default=None) -> Column:
    """Small fixed map lookup as a literal map (stays inside codegen)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.try_element_at(m, key)
    return v if default is None else F.coalesce(v, F.lit(default))
