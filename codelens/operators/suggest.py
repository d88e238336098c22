"""Code-block suggestion engine over whole files (file-level and line-level checks).

Line checks are columns of one projection over ``file_lines``; whole-file
checks are aggregates of line facts (``file_facts``), so no file text is
rebuilt. Scores are counted on the file's row of facts.

FIXED VALUES: the checked substrings, thresholds and issue texts in this
module are the source tool's values, kept verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.grams import lines_with_words
from codelens.functions.joins import BROADCAST_MAX_ROWS, is_small
from codelens.functions.text import count_substr, file_ext, map_lookup, rlike, trim_ws
from codelens.operators.project import SUGGESTION_LANGUAGES

PY_LOOKAHEAD = 5  # the suggestion engine looks at the next 5 lines


def suggestion_files(files: DataFrame) -> DataFrame:
    return files.withColumn("language", map_lookup(SUGGESTION_LANGUAGES, file_ext(F.col("rel_path")), "unknown"))


FACT_SUBSTRINGS = ["except:", "import *", "panic(", "fmt.Print", "main(", "==", "===", "var ", "+=", "for ",
                   "append(", "func "]
COUNT_SUBSTRINGS = [";", "func ", '"""', "/*"]


def file_facts(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Whole-file facts of the ``files`` (file_id, language) as aggregates over their lines (no file text is rebuilt).

    ``contains(file, s)`` is ``any(line contains s)`` and ``count(file, s)`` is
    ``sum(count(line, s))`` for strings without a newline; newlines = lines - 1.
    Partial aggregation into numbers and flags (no text is a buffer, which would
    sort the lines) keeps a huge file spread over many tasks; only a file's row
    meets its attributes. A file that comes ``n_files`` times has its lines as often.
    """
    ln, low = F.col("line"), F.lower(F.col("line"))
    aggs = [F.count(F.lit(1)).alias("n_lines")]
    aggs += [F.max(ln.contains(x)).alias(f"has_{i}") for i, x in enumerate(FACT_SUBSTRINGS)]
    aggs += [F.max(low.contains(k.lower())).alias(f"kw_{i}") for i, (k, _) in enumerate(C.SECURITY_KEYWORDS)]
    aggs += [F.sum(count_substr(ln, x)).alias(f"cnt_{i}") for i, x in enumerate(COUNT_SUBSTRINGS)]
    meta = files.groupBy("file_id").agg(F.first("language").alias("language"), F.count(F.lit(1)).alias("n_files"))
    facts = lines.groupBy("file_id").agg(*aggs).join(meta, "file_id")
    return facts.withColumns({c: F.col(c) * F.col("n_files") for c in facts.columns if c == "n_lines" or c.startswith("cnt_")})


def _has(s: str) -> Column:
    return F.col(f"has_{FACT_SUBSTRINGS.index(s)}")


def _cnt(s: str) -> Column:
    return F.col(f"cnt_{COUNT_SUBSTRINGS.index(s)}")


def _found(hits: list[Column]) -> Column:
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _keyword_issues() -> Column:
    return _found([F.when(F.col(f"kw_{i}"), F.lit(f"Security: {msg}")) for i, (_, msg) in enumerate(C.SECURITY_KEYWORDS)])


def security_keywords(facts: DataFrame) -> DataFrame:
    """RUL_SECURITY_KEYWORDS: each of 9 keywords found in the lower-cased file, at most once per file."""
    return facts.select("file_id", F.explode(_keyword_issues()).alias("issue"))


def _debug_calls() -> Column:
    """The debug calls found on a line not starting with // or #."""
    t = trim_ws(F.col("line"))
    commented = t.startswith("//") | t.startswith("#")
    return _found([F.when(F.col("line").contains(p) & ~commented, F.lit(p)) for p in C.DEBUG_CALLS])


def debug_prints(lines: DataFrame) -> DataFrame:
    """RUL_DEBUG_PRINT: one row per debug call found on a line not starting with // or #."""
    return lines.select("file_id", "line_no", F.explode(_debug_calls()).alias("pattern"))


def line_quality(lines: DataFrame) -> DataFrame:
    """Line quality issues in one pass: > 120 code points, TODO/FIXME (case-sensitive), debug calls."""
    ln = F.col("line")
    own = _found([F.when(F.length(ln) > C.LONG_LINE, F.lit("long_line")),
                  F.when(ln.contains("TODO") | ln.contains("FIXME"), F.lit("todo"))])
    debug = F.transform(_debug_calls(), lambda p: F.concat(F.lit("debug:"), p))
    return lines.select("file_id", "line_no", F.explode(F.concat(own, debug)).alias("issue"))


def _language_issues() -> Column:
    lang = F.col("language")
    return _found([
        F.when((lang == "python") & _has("except:"), F.lit("Python: Avoid bare except clauses - specify exception types")),
        F.when((lang == "python") & _has("import *"), F.lit("Python: Avoid wildcard imports - import specific items")),
        F.when((lang == "go") & _has("panic("), F.lit("Go: Consider returning errors instead of using panic")),
        F.when((lang == "go") & _has("fmt.Print") & ~_has("main("),
               F.lit("Go: Consider using structured logging instead of fmt.Print")),
        F.when(lang.isin("javascript", "typescript") & _has("==") & ~_has("==="),
               F.lit("JS: Use strict equality (===) instead of loose equality (==)")),
        F.when(lang.isin("javascript", "typescript") & _has("var "),
               F.lit("JS: Consider using 'let' or 'const' instead of 'var'")),
    ])


def language_quality(facts: DataFrame) -> DataFrame:
    """RUL_LANG_QUALITY: file-level checks by language."""
    return facts.select("file_id", F.explode(_language_issues()).alias("issue"))


def language_style(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """RUL_LANG_STYLE: Python trailing space and ``== True/False`` lines; Go unexported func lines; JS semicolons."""
    ln = F.col("line")
    py = lines.where(F.col("language") == "python")
    trailing = py.where(ln.endswith(" ")).select("file_id", "line_no", F.lit("trailing_whitespace").alias("issue"))
    eq_bool = py.where(ln.contains("==") & (ln.contains("True") | ln.contains("False"))).select(
        "file_id", "line_no", F.lit("compare_to_bool").alias("issue"))
    go = lines.where(F.col("language") == "go")
    exported = rlike(ln, r"func\s+[A-Z][a-zA-Z]*\s*\(")
    go_fn = go.where(ln.contains("func ") & ln.contains("(") & ln.contains(")") & ~exported & ~ln.contains("main(")
                     & ~trim_ws(ln).startswith("//")).select("file_id", "line_no", F.lit("unexported_func").alias("issue"))
    js = (facts.where(F.col("language").isin("javascript", "typescript") & (_cnt(";") < (F.col("n_lines") - 1) / 2))
          .select("file_id", F.lit(0).alias("line_no"), F.lit("semicolons").alias("issue")))
    return trailing.unionByName(eq_bool).unionByName(go_fn).unionByName(js)


def nested_loops_short(lines: DataFrame) -> DataFrame:
    """Performance hint: a ``for `` line with another within the next 5 lines (equi-join on line numbers)."""
    from codelens.operators.rules import nested_loops
    return nested_loops(lines, lookahead=PY_LOOKAHEAD)


def _loop_growth_issue() -> Column:
    lang = F.col("language")
    return (F.when((lang == "python") & _has("+=") & _has("for "),
                   F.lit("Performance: Consider using list comprehension instead of += in loops"))
            .when((lang == "go") & _has("append(") & _has("for "),
                  F.lit("Performance: Pre-allocate slices when size is known")))


def loop_growth(facts: DataFrame) -> DataFrame:
    """RUL_LOOP_GROWTH: Python ``+=`` with ``for ``; Go ``append(`` with ``for `` (file level)."""
    return facts.select("file_id", _loop_growth_issue().alias("issue")).where(F.col("issue").isNotNull())


def file_level(facts: DataFrame) -> DataFrame:
    """RUL_FILE_LEVEL: > 500 lines; > 3 ``func `` and no doc marker in Python/Go/Java files."""
    lang, n = F.col("language"), F.col("n_lines")
    docs = _cnt('"""') + _cnt("/*")
    hits = F.array(
        F.when(n > 500, F.format_string("File: Large file (%d lines) - consider splitting", n)),
        F.when(lang.isin("python", "go", "java") & _has("func ") & (docs == 0) & (_cnt("func ") > 3),
               F.lit("File: Consider adding documentation for functions")))
    return facts.select("file_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("suggestion"))


def block_scores(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """RUL_BLOCK_SCORE: 100 - min(80, 10 x (quality + security + performance issues)) per file.

    ``lines`` are (file_id, line_no, line) as ``file_facts`` took them. File-level
    issues are counted on the file's row of ``facts``; those of lines are counted
    in one aggregation and join it once.
    """
    found = (line_quality(lines).select("file_id", F.lit(1).alias("lq"), F.lit(0).alias("nl"))
             .unionByName(nested_loops_short(lines).select("file_id", F.lit(0).alias("lq"), F.lit(1).alias("nl")))
             .groupBy("file_id").agg(F.sum("lq").alias("lq"), F.sum("nl").alias("nl")))
    own = facts.select("file_id", "language", "n_files", F.size(_language_issues()).alias("fq"), F.size(_keyword_issues()).alias("sec"),
                       F.when(_loop_growth_issue().isNotNull(), 1).otherwise(0).alias("lg"))
    j = own.join(found, "file_id", "left").fillna(0, ["lq", "nl"])
    q, s, p = F.col("lq") * F.col("n_files") + F.col("fq"), F.col("sec"), F.col("nl") * F.col("n_files") + F.col("lg")
    return j.select("file_id", "language", q.cast("bigint").alias("quality_issues"), s.cast("bigint").alias("security_concerns"),
                    p.cast("bigint").alias("performance_hints"),
                    (100 - F.least(F.lit(80), (q + s + p) * 10)).cast("bigint").alias("overall_score"))


def error_overlap(lines: DataFrame, errors: DataFrame, first_n: int = 3, small: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """RUL_ERROR_OVERLAP: files containing a word (> 3 chars) of one of the project's first ``first_n`` errors.

    ``lines`` are (file_id, project_id, line_no, line). The words of a project
    are few (``first_n`` messages). At most ``small`` words of all projects
    (counted) are sent to the lines; more are joined by grams, so that no line
    is shuffled on its project.
    """
    from codelens.operators.process import top_k
    first = top_k(errors, ["project_id"], [F.col("seq")], first_n)
    words = (first.select("project_id", F.explode(F.split(F.lower("message"), " ")).alias("word"))
             .where(F.length("word") > 3).distinct())
    low = lines.select("file_id", "project_id", "line_no", F.lower("line").alias("_l"))
    if is_small(words, small):
        found = low.join(F.broadcast(words), "project_id").where(F.col("_l").contains(F.col("word")))
    else:
        found = lines_with_words(low, words, ["project_id"])
    return (found.select("file_id", "project_id").distinct()
            .withColumn("insight", F.lit("This code may relate to active error - verify carefully")))


def analyzer_suggestions(findings_sec: DataFrame, findings_perf: DataFrame, smells_per_file: DataFrame,
                         functions: DataFrame | None = None) -> DataFrame:
    """RUL_SUGGESTIONS: security (0.8, critical), performance (0.7, its severity), > 5 smells (0.9, medium),
    Go functions of complexity > 10 (0.9, high)."""
    sec = findings_sec.select("file_id", F.col("line_no").cast("bigint").alias("line"), F.lit("security").alias("type"),
                              F.lit("Security Vulnerability Detected").alias("title"),
                              F.format_string("Line %d: %s", "line_no", "description").alias("description"),
                              F.lit(0.8).alias("confidence"), F.lit("critical").alias("impact"),
                              F.lit("security").alias("category"))
    perf = findings_perf.select("file_id", F.col("line_no").cast("bigint").alias("line"), F.lit("optimization").alias("type"),
                                F.lit("Performance Optimization Opportunity").alias("title"),
                                F.format_string("Line %d: %s", "line_no", "issue").alias("description"),
                                F.lit(0.7).alias("confidence"), F.col("severity").alias("impact"),
                                F.lit("performance").alias("category"))
    qual = (smells_per_file.where(F.col("code_smells") > 5)
            .select("file_id", F.lit(0).cast("bigint").alias("line"), F.lit("refactoring").alias("type"),
                    F.lit("Code Quality Improvement Needed").alias("title"),
                    F.format_string("File has %d code quality issues that should be addressed", "code_smells").alias("description"),
                    F.lit(0.9).alias("confidence"), F.lit("medium").alias("impact"), F.lit("maintainability").alias("category")))
    out = sec.unionByName(perf).unionByName(qual)
    if functions is not None:
        cx = (functions.where(F.col("complexity") > C.COMPLEXITY_LIMIT)
              .select("file_id", F.col("func_line").cast("bigint").alias("line"), F.lit("refactoring").alias("type"),
                      F.concat(F.lit("High Complexity in "), F.coalesce("func_name", F.lit("anonymous"))).alias("title"),
                      F.format_string("Function has cyclomatic complexity of %d (recommended: <10)", "complexity")
                      .alias("description"),
                      F.lit(0.9).alias("confidence"), F.lit("high").alias("impact"), F.lit("maintainability").alias("category")))
        out = out.unionByName(cx)
    return out


def parse_limit(text: Column, default: int = 50) -> Column:
    """FLT_SUGGESTIONS limit: an integer in 1..1000, else the default."""
    v = text.try_cast("bigint")
    return F.when((v > 0) & (v <= 1000), v).otherwise(F.lit(default))
