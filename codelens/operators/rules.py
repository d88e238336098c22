"""Rule scans over file lines (static analysis without a parser).

Input frames:
  files       file_id, project_id, rel_path (ext and content optional)
  file_lines  file_id, line_no, line

All line rules are columns of one projection over the lines (one pass, no
lines x rules join); neighbour rules (nested loops, empty error blocks) are
equi-joins on (file_id, line_no + k), whose keys are unique per line, so a
huge file never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.joins import broadcast_if_small
from codelens.functions.text import extract, file_ext, map_lookup, rlike, trim_ws
from codelens.functions.windows import LINE_SPAN, ffill


def analyzable_files(files: DataFrame) -> DataFrame:
    """Files the analyzer reads, with its language name (10 extensions)."""
    ext = file_ext(F.col("rel_path"))
    return (files.withColumn("ext", ext)
            .where(F.col("ext").isin(C.ANALYZABLE_EXTS))
            .withColumn("language", map_lookup(C.ANALYZER_LANGUAGES, F.col("ext"), "unknown")))


def code_files(files: DataFrame) -> DataFrame:
    """Files the todo scanner reads (13 code extensions), core language names."""
    ext = file_ext(F.col("rel_path"))
    return (files.withColumn("ext", ext)
            .where(F.col("ext").isin(C.CODE_EXTS))
            .withColumn("language", map_lookup(C.CORE_LANGUAGES, F.col("ext"), "text")))


def attach(lines: DataFrame, files: DataFrame, cols=("project_id", "rel_path", "language")) -> DataFrame:
    """Lines of the given files, carrying file attributes.

    The per-file side (no content, one row per file) is broadcast when a
    bounded count proves it small; otherwise both sides shuffle on file_id
    and AQE splits a skewed (huge) file's partition.
    """
    meta = broadcast_if_small(files.select("file_id", *cols))
    return lines.join(meta, "file_id")


# ---------------------------------------------------------------- security

def security_hits(line: Column) -> Column:
    """Array of the descriptions of every security regex the line matches."""
    return F.filter(F.array(*[F.when(rlike(line, p), F.lit(d)) for p, d in C.SECURITY_PATTERNS]),
                    lambda x: x.isNotNull())


def security_findings(lines: DataFrame) -> DataFrame:
    """RUL_SECURITY: one row per (line, matching regex), severity high."""
    return (lines.select("*", F.explode(security_hits(F.col("line"))).alias("description"))
            .withColumn("severity", F.lit("high"))
            .withColumn("issue_type", F.lit("vulnerability")))


# ---------------------------------------------------------------- smells

def long_line(line: Column, chars: bool = False) -> Column:
    """Longer than 120: bytes (analyzer) or code points (suggestion engine)."""
    n = F.length(line) if chars else F.octet_length(line)
    return n > F.lit(C.LONG_LINE)


def todo_smell(line: Column) -> Column:
    return rlike(line, C.TODO_SMELL_PATTERN)


def go_smell_flags(line: Column) -> dict[str, Column]:
    no_comment = ~line.contains("//")
    return {
        "panic_usage": line.contains("panic(") & no_comment,
        "debugging_print": line.contains("fmt.Print") & no_comment,
    }


def empty_error_blocks(lines: DataFrame) -> DataFrame:
    """Lines with ``if err != nil {`` whose next line is just ``}`` (lead via equi-join)."""
    opens = lines.where(F.col("line").contains("if err != nil {")).select("file_id", "line_no")
    closes = (lines.where(trim_ws(F.col("line")) == F.lit("}"))
              .select("file_id", (F.col("line_no") - 1).alias("line_no")))
    return opens.join(closes, ["file_id", "line_no"], "left_semi")


def nested_loops(lines: DataFrame, lookahead: int = C.NESTED_LOOP_LOOKAHEAD) -> DataFrame:
    """Lines containing ``for `` with another ``for `` line within the next ``lookahead`` lines.

    Every loop line j names the lines j-1 .. j-lookahead it would flag; the
    distinct targets are semi-joined back to loop lines: exact, no window.
    """
    loops = lines.where(F.col("line").contains("for ")).select("file_id", "line_no")
    targets = (loops.select("file_id", F.explode(F.sequence(F.col("line_no") - lookahead,
                                                            F.col("line_no") - 1)).alias("line_no"))
               .distinct())
    return loops.join(targets, ["file_id", "line_no"], "left_semi")


def string_concat(line: Column) -> Column:
    return line.contains("+=") & line.contains('"')


# ---------------------------------------------------------------- todos

def todos(lines: DataFrame) -> DataFrame:
    """RUL_TODOS: first marker in priority order; message from the marker on, trimmed."""
    up = F.upper(F.col("line"))
    kind = F.coalesce(*[F.when(up.contains(m), F.lit(m)) for m in C.TODO_MARKERS])
    pos = F.instr(up, kind)
    return (lines.withColumn("todo_type", kind)
            .where(F.col("todo_type").isNotNull())
            .withColumn("message", trim_ws(F.substring(F.col("line"), pos, 1 << 30))))


# ---------------------------------------------------------------- Go functions

_KEYWORDS = ["if", "for", "switch", "case", "default"]
_STRINGS = r'"([^"\\]|\\.)*"|`[^`]*`|' + r"'([^'\\]|\\.)*'"


def code_tokens(line: Column) -> Column:
    """Identifier-like tokens of a line after string literals and // comments are removed."""
    code = F.regexp_replace(F.regexp_replace(line, _STRINGS, ""), "//.*$", "")
    return F.split(code, "[^A-Za-z0-9_]+")


def branch_keywords(line: Column) -> Column:
    """How many if/for/switch/case/default tokens a line of code has."""
    return F.size(F.filter(code_tokens(line), lambda t: t.isin(_KEYWORDS)))


def go_function_mark(go: Column, line: Column, no: Column) -> Column:
    """The line number where a Go function starts (``^func ``), 0 where one ends (``^}``), else null."""
    return F.when(go & rlike(line, r"^func "), no).when(go & rlike(line, r"^}"), F.lit(0))


def cyclomatic(lines: DataFrame) -> DataFrame:
    """RUL_CYCLOMATIC, per Go function: 1 + if/for/switch/case/default tokens in its lines (approximation of the AST walk).

    A function starts at ``^func `` and ends at the next ``^}``. Each line is
    reduced to numbers first; the open function is forward-filled over them
    (bucketed, safe for huge files), so no text is shuffled.
    """
    line, no = F.col("line"), F.col("line_no").cast("bigint")
    name = extract(line, r"^func\s+(\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)", 2)
    marked = lines.select("file_id", no.alias("line_no"), go_function_mark(F.lit(True), line, no).alias("_after"), branch_keywords(line).alias("_kw"),
                          F.when(rlike(line, r"^func "), name).alias("_name"), F.length(line).alias("_chars"))
    filled = ffill(marked, ["file_id"], "line_no", "_after", "_prev", inclusive=False, span=LINE_SPAN)
    start = F.when(F.col("_after") > 0, F.col("_after")).when(F.col("_prev") > 0, F.col("_prev"))
    return (filled.withColumn("func_line", start).where(F.col("func_line").isNotNull()).groupBy("file_id", "func_line")
            .agg((F.lit(1) + F.sum("_kw")).cast("bigint").alias("complexity"),
                 F.max(F.when(F.col("line_no") == F.col("func_line"), F.col("_name"))).alias("func_name"),
                 F.sum("_chars").cast("bigint").alias("body_chars")))


def go_metrics(lines: DataFrame) -> DataFrame:
    """RUL_GO_METRICS: functions, types and interfaces per Go file (top-level declarations)."""
    return lines.groupBy("file_id").agg(
        F.count_if(rlike(F.col("line"), r"^func ")).cast("bigint").alias("functions"),
        F.count_if(rlike(F.col("line"), r"^type ")).cast("bigint").alias("types"),
        F.count_if(rlike(F.col("line"), r"^type\s+[A-Za-z_][A-Za-z0-9_]*\s+interface(\s|\{|$)")).cast("bigint").alias("interfaces"),
    )
