"""Code-analysis queries: rule scans, file scores, project reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.operators import analysis as A
from codelens.operators import rules as R
from codelens.plans.fixtures import duckdb_with
from codelens.plans.registry import Views, query, sql_list, sql_str

# ------------------------------------------------------------ DuckDB building blocks

WS = r"[\t\n\f\r ]"
D_TRIM = "regexp_replace({x}, '^" + WS + "+|" + WS + "+$', '', 'g')"
D_EXT = r"lower(regexp_extract({x}, '(\.[^./]*)$', 1))"


def d_lang_case(mapping: dict, default: str, col: str = "ext") -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {sql_str(default)} END"


D_SEC_ARRAY = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(line, {sql_str(p)}) THEN {sql_str(d)} END" for p, d in C.SECURITY_PATTERNS
) + "], lambda x: x IS NOT NULL)"

D_STRINGS = r'''"([^"\\]|\\.)*"|`[^`]*`|''' + r"""'([^'\\]|\\.)*'"""
D_KW = (f"len(list_filter(string_split_regex(regexp_replace(regexp_replace(line, {sql_str(D_STRINGS)}, '', 'g'), "
        "'//.*$', '', 'g'), '[^A-Za-z0-9_]+'), lambda t: t IN ('if', 'for', 'switch', 'case', 'default')))")
D_FUNC_NAME = r"'^func\s+(\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)'"

ANALYSIS_CTES = [
    ("af", f"""
SELECT file_id, project_id, rel_path, ext, {d_lang_case(C.ANALYZER_LANGUAGES, 'unknown')} AS language
FROM (SELECT file_id, project_id, rel_path, {D_EXT.format(x='rel_path')} AS ext FROM files) s
WHERE ext IN ({sql_list(C.ANALYZABLE_EXTS)})"""),
    ("al", "SELECT l.file_id, l.line_no, l.line, af.language FROM file_lines l JOIN af USING (file_id)"),
    ("flags", f"""
SELECT file_id, line_no, line, language,
  strlen(line) > 120 AS long_line,
  regexp_matches(line, {sql_str(C.TODO_SMELL_PATTERN)}) AS todo_comment,
  language = 'go' AND contains(line, 'panic(') AND NOT contains(line, '//') AS panic_usage,
  language = 'go' AND contains(line, 'fmt.Print') AND NOT contains(line, '//') AS debugging_print,
  len({D_SEC_ARRAY}) AS security,
  contains(line, '+=') AND contains(line, '"') AS string_concatenation,
  contains(line, 'for ') AND coalesce(max(CAST(contains(line, 'for ') AS INT)) OVER (
      PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), 0) = 1 AS nested_loop,
  language = 'go' AND contains(line, 'if err != nil {{') AND
      coalesce(lead({D_TRIM.format(x='line')}) OVER (PARTITION BY file_id ORDER BY line_no) = '}}', false) AS empty_error
FROM al"""),
    ("gm", r"""
SELECT file_id, line_no, line,
  CASE WHEN regexp_matches(line, '^func ') THEN line_no WHEN regexp_matches(line, '^\}') THEN 0 END AS after
FROM al WHERE language = 'go'"""),
    ("gp", """
SELECT *, last_value(after IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM gm"""),
    ("gf", """
SELECT *, CASE WHEN regexp_matches(line, '^func ') THEN line_no WHEN prev > 0 THEN prev END AS func_line FROM gp"""),
    ("cyc", f"""
SELECT file_id, func_line, CAST(1 + sum({D_KW}) AS BIGINT) AS complexity,
  max(CASE WHEN line_no = func_line AND regexp_matches(line, {D_FUNC_NAME})
           THEN regexp_extract(line, {D_FUNC_NAME}, 2) END) AS func_name,
  CAST(sum(length(line)) AS BIGINT) AS body_chars
FROM gf WHERE func_line IS NOT NULL GROUP BY file_id, func_line"""),
    ("fc", """
SELECT af.file_id, af.project_id, af.rel_path, af.language,
  CAST(count(f.line_no) AS BIGINT) AS lines,
  CAST(count_if(f.long_line) AS BIGINT) AS long_lines,
  CAST(count_if(f.todo_comment) AS BIGINT) AS todo_comments,
  CAST(count_if(f.panic_usage) AS BIGINT) AS panic_usages,
  CAST(count_if(f.debugging_print) AS BIGINT) AS debug_prints,
  CAST(coalesce(sum(f.security), 0) AS BIGINT) AS security_issues,
  CAST(count_if(f.string_concatenation) AS BIGINT) AS string_concats,
  CAST(count_if(f.empty_error) AS BIGINT) AS empty_error_blocks,
  CAST(count_if(f.nested_loop) AS BIGINT) AS nested_loops,
  CAST(coalesce(max(cf.n), 0) AS BIGINT) AS complex_functions
FROM af LEFT JOIN flags f USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n FROM cyc WHERE complexity > 10 GROUP BY file_id) cf USING (file_id)
GROUP BY af.file_id, af.project_id, af.rel_path, af.language"""),
    ("sc0", """
SELECT *, long_lines + todo_comments + panic_usages + debug_prints + empty_error_blocks AS smells,
  nested_loops + string_concats AS perf FROM fc"""),
    ("scores", """
SELECT file_id, project_id, rel_path, language, lines,
  CAST(smells AS BIGINT) AS code_smells, security_issues, CAST(perf AS BIGINT) AS performance_issues,
  CAST(security_issues + perf + CASE WHEN smells > 5 THEN 1 ELSE 0 END + complex_functions AS BIGINT) AS suggestions,
  CAST(least(100, smells * 5 + security_issues * 20 + perf * 10) AS BIGINT) AS complexity_score,
  CASE WHEN least(100, smells * 5 + security_issues * 20 + perf * 10) <= 20 THEN 'excellent'
       WHEN least(100, smells * 5 + security_issues * 20 + perf * 10) <= 40 THEN 'good'
       WHEN least(100, smells * 5 + security_issues * 20 + perf * 10) <= 60 THEN 'fair'
       WHEN least(100, smells * 5 + security_issues * 20 + perf * 10) <= 80 THEN 'poor' ELSE 'critical' END AS maintainability,
  CAST(security_issues * 4 + perf * 2 + smells AS BIGINT) AS technical_debt,
  CAST(security_issues + perf + smells AS BIGINT) AS total_issues,
  nested_loops, string_concats
FROM sc0"""),
    ("summary", """
SELECT project_id, CAST(count(*) AS BIGINT) AS analyzed_files, CAST(sum(lines) AS BIGINT) AS total_lines,
  avg(complexity_score) AS average_complexity,
  CAST(sum(security_issues) AS BIGINT) AS total_security_issues,
  CAST(sum(performance_issues) AS BIGINT) AS total_performance_issues,
  CAST(sum(code_smells) AS BIGINT) AS total_code_smells,
  CAST(sum(suggestions) AS BIGINT) AS total_suggestions,
  CAST(sum(technical_debt) AS BIGINT) AS technical_debt_hours,
  CAST(greatest(0, 100 - floor(avg(complexity_score))) AS BIGINT) AS overall_score
FROM scores GROUP BY project_id"""),
]


def _cte_upto(name: str) -> list[tuple[str, str]]:
    names = [n for n, _ in ANALYSIS_CTES]
    return ANALYSIS_CTES[: names.index(name) + 1]


def d_analysis(upto: str, body: str) -> str:
    return duckdb_with(["files", "file_lines"], _cte_upto(upto)) + body


# ------------------------------------------------------------ Spark plans

def _analysis_inputs(spark, sf_dir):
    v = Views(spark, sf_dir)
    return v("files"), v("file_lines")


def _analyzed_lines(spark, sf_dir):
    files, lines = _analysis_inputs(spark, sf_dir)
    af = R.analyzable_files(files)
    return R.attach(lines, af, cols=("project_id", "language"))


def _scores(spark, sf_dir):
    files, lines = _analysis_inputs(spark, sf_dir)
    return A.file_scores(A.file_issue_counts(files, lines))


def _summary(spark, sf_dir):
    return A.project_summary(_scores(spark, sf_dir))


@query("rul_security", d_analysis("al", """
SELECT af.project_id, al.file_id, CAST(al.line_no AS BIGINT) AS line_no, d.description, 'high' AS severity
FROM al JOIN af USING (file_id),
LATERAL (SELECT unnest(""" + D_SEC_ARRAY + """) AS description) d"""))
def rul_security(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir)
    return (R.security_findings(lines)
            .select("project_id", "file_id", F.col("line_no").cast("bigint").alias("line_no"),
                    "description", "severity"))


@query("rul_long_line", d_analysis("al", """
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, CAST(strlen(line) AS BIGINT) AS byte_length,
  CAST(length(line) AS BIGINT) AS char_length, length(line) > 120 AS over_in_chars
FROM al WHERE strlen(line) > 120"""))
def rul_long_line(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir)
    return (lines.where(R.long_line(F.col("line")))
            .select("file_id", F.col("line_no").cast("bigint").alias("line_no"),
                    F.octet_length("line").cast("bigint").alias("byte_length"),
                    F.length("line").cast("bigint").alias("char_length"),
                    R.long_line(F.col("line"), chars=True).alias("over_in_chars")))


@query("rul_todo_smell", d_analysis("al", f"""
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, 'todo_comment' AS smell, 'medium' AS priority
FROM al WHERE regexp_matches(line, {sql_str(C.TODO_SMELL_PATTERN)})"""))
def rul_todo_smell(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir)
    return (lines.where(R.todo_smell(F.col("line")))
            .select("file_id", F.col("line_no").cast("bigint").alias("line_no"),
                    F.lit("todo_comment").alias("smell"), F.lit("medium").alias("priority")))


@query("rul_go_smells", d_analysis("flags", """
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, smell FROM (
  SELECT file_id, line_no, 'panic_usage' AS smell FROM flags WHERE panic_usage
  UNION ALL SELECT file_id, line_no, 'debugging_print' FROM flags WHERE debugging_print
  UNION ALL SELECT file_id, line_no, 'empty_error_handling' FROM flags WHERE empty_error) s"""))
def rul_go_smells(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir).where(F.col("language") == "go")
    flags = R.go_smell_flags(F.col("line"))
    simple = lines.select("file_id", "line_no", F.explode(F.filter(F.array(
        *[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())).alias("smell"))
    empty = R.empty_error_blocks(lines).withColumn("smell", F.lit("empty_error_handling"))
    return (simple.unionByName(empty)
            .select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "smell"))


@query("rul_nested_loops", d_analysis("flags", """
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, 'nested_loops' AS issue, 'medium' AS severity
FROM flags WHERE nested_loop"""))
def rul_nested_loops(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir)
    return (R.nested_loops(lines)
            .select("file_id", F.col("line_no").cast("bigint").alias("line_no"),
                    F.lit("nested_loops").alias("issue"), F.lit("medium").alias("severity")))


@query("rul_str_concat", d_analysis("flags", """
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, 'string_concatenation' AS issue, 'low' AS severity
FROM flags WHERE string_concatenation"""))
def rul_str_concat(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir)
    return (lines.where(R.string_concat(F.col("line")))
            .select("file_id", F.col("line_no").cast("bigint").alias("line_no"),
                    F.lit("string_concatenation").alias("issue"), F.lit("low").alias("severity")))


@query("rul_cyclomatic", d_analysis("cyc", """
SELECT file_id, CAST(func_line AS BIGINT) AS func_line, func_name, complexity,
  complexity > 10 AS needs_refactoring FROM cyc"""))
def rul_cyclomatic(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir).where(F.col("language") == "go")
    return (R.cyclomatic(lines)
            .select("file_id", F.col("func_line").cast("bigint").alias("func_line"), "func_name", "complexity",
                    (F.col("complexity") > C.COMPLEXITY_LIMIT).alias("needs_refactoring")))


@query("rul_long_function", d_analysis("cyc", """
SELECT file_id, CAST(func_line AS BIGINT) AS func_line, func_name, body_chars, 'medium' AS severity
FROM cyc WHERE body_chars >= 500"""))
def rul_long_function(spark, sf_dir):
    lines = _analyzed_lines(spark, sf_dir).where(F.col("language") == "go")
    return (R.cyclomatic(lines).where(F.col("body_chars") >= 500)
            .select("file_id", F.col("func_line").cast("bigint").alias("func_line"), "func_name", "body_chars",
                    F.lit("medium").alias("severity")))


@query("rul_go_metrics", d_analysis("al", r"""
SELECT file_id,
  CAST(count_if(regexp_matches(line, '^func ')) AS BIGINT) AS functions,
  CAST(count_if(regexp_matches(line, '^type ')) AS BIGINT) AS types,
  CAST(count_if(regexp_matches(line, '^type[\t\n\f\r ]+[A-Za-z_][A-Za-z0-9_]*[\t\n\f\r ]+interface([\t\n\f\r ]|\{|$)')) AS BIGINT) AS interfaces
FROM al WHERE language = 'go' GROUP BY file_id"""))
def rul_go_metrics(spark, sf_dir):
    return R.go_metrics(_analyzed_lines(spark, sf_dir).where(F.col("language") == "go"))


@query("rul_file_score", d_analysis("scores", """
SELECT file_id, project_id, language, lines, code_smells, security_issues, performance_issues,
  suggestions, complexity_score, maintainability, technical_debt FROM scores"""))
def rul_file_score(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "file_id", "project_id", "language", "lines", "code_smells", "security_issues", "performance_issues",
        "suggestions", "complexity_score", "maintainability", "technical_debt")


@query("agg_analysis", d_analysis("summary", """
SELECT project_id, analyzed_files, total_lines, round(average_complexity, 6) AS average_complexity,
  total_security_issues, total_performance_issues, total_code_smells, total_suggestions,
  technical_debt_hours, overall_score FROM summary"""))
def agg_analysis(spark, sf_dir):
    return _summary(spark, sf_dir).withColumn("average_complexity", F.round("average_complexity", 6))


@query("agg_maintainability", d_analysis("scores", """
SELECT project_id,
  CAST(count_if(maintainability = 'excellent') AS BIGINT) AS excellent,
  CAST(count_if(maintainability = 'good') AS BIGINT) AS good,
  CAST(count_if(maintainability = 'fair') AS BIGINT) AS fair,
  CAST(count_if(maintainability = 'poor') AS BIGINT) AS poor,
  CAST(count_if(maintainability = 'critical') AS BIGINT) AS critical
FROM scores GROUP BY project_id"""))
def agg_maintainability(spark, sf_dir):
    return A.maintainability_distribution(_scores(spark, sf_dir))


@query("agg_complexity_hist", d_analysis("scores", """
SELECT project_id,
  CAST(count_if(complexity_score <= 20) AS BIGINT) AS low,
  CAST(count_if(complexity_score > 20 AND complexity_score <= 50) AS BIGINT) AS medium,
  CAST(count_if(complexity_score > 50 AND complexity_score <= 80) AS BIGINT) AS high,
  CAST(count_if(complexity_score > 80) AS BIGINT) AS very_high
FROM scores GROUP BY project_id"""))
def agg_complexity_hist(spark, sf_dir):
    return A.complexity_distribution(_scores(spark, sf_dir))


@query("agg_lang_quality", d_analysis("scores", """
SELECT project_id, language, CAST(count(*) AS BIGINT) AS files,
  CAST(sum(complexity_score) AS BIGINT) AS total_complexity, CAST(sum(total_issues) AS BIGINT) AS total_issues,
  round(avg(complexity_score), 6) AS avg_complexity, round(avg(total_issues), 6) AS avg_issues
FROM scores GROUP BY project_id, language"""))
def agg_lang_quality(spark, sf_dir):
    return (A.language_quality(_scores(spark, sf_dir))
            .withColumn("avg_complexity", F.round("avg_complexity", 6))
            .withColumn("avg_issues", F.round("avg_issues", 6)))


@query("agg_security", d_analysis("scores", """
SELECT project_id, CAST(sum(security_issues) AS BIGINT) AS total_issues, CAST(0 AS BIGINT) AS critical,
  CAST(sum(security_issues) AS BIGINT) AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low,
  CAST(least(100, sum(security_issues) * 7) AS BIGINT) AS risk_score,
  CASE WHEN sum(security_issues) > 0 THEN '🔒 Fix high-priority security vulnerabilities' ELSE '' END AS recommendations
FROM scores GROUP BY project_id"""))
def agg_security(spark, sf_dir):
    return A.security_report(_scores(spark, sf_dir))


@query("agg_performance", d_analysis("scores", """
SELECT project_id, CAST(sum(nested_loops) + sum(string_concats) AS BIGINT) AS total_issues,
  CAST(sum(nested_loops) AS BIGINT) AS nested_loops, CAST(sum(string_concats) AS BIGINT) AS string_concatenation,
  CAST(greatest(0, 100 - floor((sum(nested_loops) + sum(string_concats)) / count(*) * 50)) AS BIGINT) AS performance_score,
  'high' AS nested_loops_priority, 'medium' AS string_concatenation_priority
FROM scores GROUP BY project_id"""))
def agg_performance(spark, sf_dir):
    return A.performance_report(_scores(spark, sf_dir))


@query("rec_project", d_analysis("summary", """
SELECT project_id, CAST(pos - 1 AS BIGINT) AS pos, recommendation FROM (
  SELECT project_id, unnest(recs) AS recommendation, generate_subscripts(recs, 1) AS pos FROM (
    SELECT project_id, list_filter([
      CASE WHEN total_security_issues > 0 THEN printf('🔒 Address %d security issues immediately - these pose serious risks', total_security_issues) END,
      CASE WHEN average_complexity > 50 THEN '🔧 Consider refactoring high-complexity functions to improve maintainability' END,
      CASE WHEN technical_debt_hours > 40 THEN printf('⏰ Allocate %d hours to address technical debt', technical_debt_hours) END,
      CASE WHEN total_performance_issues > 10 THEN '⚡ Performance optimization opportunities identified - consider prioritizing high-impact improvements' END,
      CASE WHEN overall_score > 80 THEN '✅ Code quality is excellent! Consider implementing automated quality gates'
           WHEN overall_score < 60 THEN '⚠️ Code quality needs improvement - focus on addressing critical issues first' END
    ], lambda x: x IS NOT NULL) AS recs FROM summary) s) t"""))
def rec_project(spark, sf_dir):
    return (A.project_recommendations(_summary(spark, sf_dir))
            .withColumn("pos", F.col("pos").cast("bigint")))


@query("rec_immediate", d_analysis("summary", """
SELECT project_id, action FROM (
  SELECT project_id, unnest(list_filter([
    CASE WHEN total_security_issues > 0 THEN 'Fix security vulnerabilities' END,
    CASE WHEN average_complexity > 80 THEN 'Refactor high-complexity functions' END,
    CASE WHEN total_performance_issues > 5 THEN 'Optimize performance bottlenecks' END], lambda x: x IS NOT NULL)) AS action
  FROM summary) s"""))
def rec_immediate(spark, sf_dir):
    return A.immediate_actions(_summary(spark, sf_dir))
