"""Suggestion-engine queries (file and line checks, block score, analyzer suggestions).

Whole-file checks are aggregates of line facts (``file_facts``), so no file
text is rebuilt and the checks see the same lines as the line rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.operators import analysis as A
from codelens.operators import rules as R
from codelens.operators import suggest as SG
from codelens.operators.project import SUGGESTION_LANGUAGES
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.q_analysis import D_SEC_ARRAY, _cte_upto
from codelens.plans.q_diagnostics import D_ACTIVE, active_errors
from codelens.plans.q_project import D_EXT, d_case, project_key
from codelens.plans.registry import Views, query, sql_str

SUGGESTION_CATEGORY = "security"
SUGGESTION_LIMIT = "50"

D_SF = ("sf", f"SELECT file_id, project_id, rel_path, {d_case(SUGGESTION_LANGUAGES, D_EXT, 'unknown')} AS language FROM files")
D_SL = ("sl", "SELECT l.file_id, l.line_no, l.line, sf.language, sf.project_id FROM file_lines l JOIN sf USING (file_id)")


def d_cnt(c: str, sub: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, {sql_str(sub)}, ''))) / {len(sub)} AS BIGINT)"


def has(x: str) -> str:
    return f"has_{SG.FACT_SUBSTRINGS.index(x)}"


def cnt(x: str) -> str:
    return f"cnt_{SG.COUNT_SUBSTRINGS.index(x)}"


def _d_facts() -> tuple[str, str]:
    cols = ["any_value(language) AS language", "count(*) AS n_lines"]
    cols += [f"bool_or(contains(line, {sql_str(x)})) AS has_{i}" for i, x in enumerate(SG.FACT_SUBSTRINGS)]
    cols += [f"bool_or(contains(lower(line), {sql_str(k.lower())})) AS kw_{i}" for i, (k, _) in enumerate(C.SECURITY_KEYWORDS)]
    cols += [f"sum({d_cnt('line', x)}) AS cnt_{i}" for i, x in enumerate(SG.COUNT_SUBSTRINGS)]
    return ("facts", "SELECT file_id, " + ", ".join(cols) + " FROM sl GROUP BY file_id")


def d_sug(body: str, ctes=()) -> str:
    return duckdb_with(["files", "file_lines"], [D_SF, D_SL, _d_facts(), *ctes]) + body


def _sfiles(spark, sf_dir):
    return SG.suggestion_files(Views(spark, sf_dir)("files"))


def _slines(spark, sf_dir):
    return R.attach(Views(spark, sf_dir)("file_lines"), _sfiles(spark, sf_dir), cols=("language", "project_id"))


def _facts(spark, sf_dir):
    return SG.file_facts(Views(spark, sf_dir)("file_lines"), _sfiles(spark, sf_dir).select("file_id", "language"))


D_KEYWORDS = " UNION ALL ".join(
    f"SELECT file_id, {sql_str('Security: ' + msg)} AS issue FROM facts WHERE kw_{i}"
    for i, (_, msg) in enumerate(C.SECURITY_KEYWORDS))


@query("rul_security_keywords", d_sug(D_KEYWORDS))
def rul_security_keywords(spark, sf_dir):
    return SG.security_keywords(_facts(spark, sf_dir))


D_DEBUG = " UNION ALL ".join(
    f"""SELECT file_id, CAST(line_no AS BIGINT) AS line_no, {sql_str(p)} AS pattern FROM sl WHERE contains(line, {sql_str(p)})
  AND NOT starts_with({duck.trim('line')}, '//') AND NOT starts_with({duck.trim('line')}, '#')""" for p in C.DEBUG_CALLS)


@query("rul_debug_print", d_sug(D_DEBUG))
def rul_debug_print(spark, sf_dir):
    d = SG.debug_prints(_slines(spark, sf_dir))
    return d.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "pattern")


D_LANG_Q = f"""
SELECT file_id, 'Python: Avoid bare except clauses - specify exception types' AS issue FROM facts WHERE language = 'python' AND {has('except:')}
UNION ALL SELECT file_id, 'Python: Avoid wildcard imports - import specific items' FROM facts WHERE language = 'python' AND {has('import *')}
UNION ALL SELECT file_id, 'Go: Consider returning errors instead of using panic' FROM facts WHERE language = 'go' AND {has('panic(')}
UNION ALL SELECT file_id, 'Go: Consider using structured logging instead of fmt.Print' FROM facts
  WHERE language = 'go' AND {has('fmt.Print')} AND NOT {has('main(')}
UNION ALL SELECT file_id, 'JS: Use strict equality (===) instead of loose equality (==)' FROM facts
  WHERE language IN ('javascript', 'typescript') AND {has('==')} AND NOT {has('===')}
UNION ALL SELECT file_id, 'JS: Consider using ''let'' or ''const'' instead of ''var''' FROM facts
  WHERE language IN ('javascript', 'typescript') AND {has('var ')}"""


@query("rul_lang_quality", d_sug(D_LANG_Q))
def rul_lang_quality(spark, sf_dir):
    return SG.language_quality(_facts(spark, sf_dir))


@query("rul_lang_style", d_sug(f"""
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, 'trailing_whitespace' AS issue FROM sl WHERE language = 'python' AND suffix(line, ' ')
UNION ALL SELECT file_id, CAST(line_no AS BIGINT), 'compare_to_bool' FROM sl
  WHERE language = 'python' AND contains(line, '==') AND (contains(line, 'True') OR contains(line, 'False'))
UNION ALL SELECT file_id, CAST(line_no AS BIGINT), 'unexported_func' FROM sl
  WHERE language = 'go' AND contains(line, 'func ') AND contains(line, '(') AND contains(line, ')')
  AND NOT regexp_matches(line, 'func\\s+[A-Z][a-zA-Z]*\\s*\\(') AND NOT contains(line, 'main(') AND NOT starts_with({duck.trim('line')}, '//')
UNION ALL SELECT file_id, CAST(0 AS BIGINT), 'semicolons' FROM facts WHERE language IN ('javascript', 'typescript')
  AND {cnt(';')} < (n_lines - 1) / 2"""))
def rul_lang_style(spark, sf_dir):
    s = SG.language_style(_facts(spark, sf_dir), _slines(spark, sf_dir))
    return s.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "issue")


D_LOOPG = f"""
SELECT file_id, CASE WHEN language = 'python' AND {has('+=')} AND {has('for ')}
    THEN 'Performance: Consider using list comprehension instead of += in loops'
  WHEN language = 'go' AND {has('append(')} AND {has('for ')}
    THEN 'Performance: Pre-allocate slices when size is known' END AS issue FROM facts"""


@query("rul_loop_growth", d_sug(f"SELECT * FROM ({D_LOOPG}) x WHERE issue IS NOT NULL"))
def rul_loop_growth(spark, sf_dir):
    return SG.loop_growth(_facts(spark, sf_dir))


@query("rul_file_level", d_sug(f"""
SELECT file_id, printf('File: Large file (%d lines) - consider splitting', n_lines) AS suggestion FROM facts WHERE n_lines > 500
UNION ALL
SELECT file_id, 'File: Consider adding documentation for functions' FROM facts WHERE language IN ('python', 'go', 'java')
  AND {has('func ')} AND {cnt('"' * 3)} + {cnt('/*')} = 0 AND {cnt('func ')} > 3"""))
def rul_file_level(spark, sf_dir):
    return SG.file_level(_facts(spark, sf_dir))


D_BLOCK = ("blk", f"""
SELECT facts.file_id, facts.language,
  CAST(coalesce(lq.n, 0) + coalesce(fq.n, 0) AS BIGINT) AS quality_issues, CAST(coalesce(sk.n, 0) AS BIGINT) AS security_concerns,
  CAST(coalesce(nl.n, 0) + coalesce(lg.n, 0) AS BIGINT) AS performance_hints
FROM facts
LEFT JOIN (SELECT file_id, count(*) AS n FROM (
    SELECT file_id FROM sl WHERE length(line) > 120
    UNION ALL SELECT file_id FROM sl WHERE contains(line, 'TODO') OR contains(line, 'FIXME')
    UNION ALL SELECT file_id FROM ({D_DEBUG}) d) x GROUP BY file_id) lq USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n FROM ({D_LANG_Q}) y GROUP BY file_id) fq USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n FROM ({D_KEYWORDS}) z GROUP BY file_id) sk USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n FROM (
    SELECT file_id, contains(line, 'for ') AND coalesce(max(CAST(contains(line, 'for ') AS INT)) OVER (
      PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) = 1 AS hit FROM sl) w
    WHERE hit GROUP BY file_id) nl USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n FROM ({D_LOOPG}) v WHERE issue IS NOT NULL GROUP BY file_id) lg USING (file_id)""")


@query("rul_block_score", d_sug("""
SELECT *, CAST(100 - least(80, (quality_issues + security_concerns + performance_hints) * 10) AS BIGINT) AS overall_score FROM blk""",
                               [D_BLOCK]))
def rul_block_score(spark, sf_dir):
    return SG.block_scores(_facts(spark, sf_dir), Views(spark, sf_dir)("file_lines"))


@query("rul_error_overlap", duckdb_with(["files", "file_lines", "tool_output"], [D_SF, D_SL]) + f"""
, fe AS (SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, message, row_number() OVER (
    PARTITION BY 'src' || CAST(project_id % 20 AS VARCHAR) ORDER BY seq) AS r FROM ({D_ACTIVE}) a),
w AS (SELECT DISTINCT project_id, word FROM (SELECT project_id, unnest(string_split(lower(message), ' ')) AS word FROM fe WHERE r <= 3) s
      WHERE length(word) > 3)
SELECT DISTINCT l.file_id, l.project_id, 'This code may relate to active error - verify carefully' AS insight
FROM sl l JOIN w ON l.project_id = w.project_id WHERE contains(lower(l.line), w.word)""")
def rul_error_overlap(spark, sf_dir):
    errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    return SG.error_overlap(_slines(spark, sf_dir), errs)


SUG_CTES = _cte_upto("scores") + [
    ("secf", "SELECT al.file_id, al.line_no, unnest(" + D_SEC_ARRAY + ") AS description FROM al"),
    ("sugg", """
SELECT file_id, CAST(line_no AS BIGINT) AS line, 'security' AS type, 'Security Vulnerability Detected' AS title,
  printf('Line %d: %s', line_no, description) AS description, CAST(0.8 AS DOUBLE) AS confidence, 'critical' AS impact, 'security' AS category FROM secf
UNION ALL
SELECT file_id, CAST(line_no AS BIGINT), 'optimization', 'Performance Optimization Opportunity', printf('Line %d: %s', line_no, 'nested_loops'),
  0.7, 'medium', 'performance' FROM flags WHERE nested_loop
UNION ALL
SELECT file_id, CAST(line_no AS BIGINT), 'optimization', 'Performance Optimization Opportunity', printf('Line %d: %s', line_no, 'string_concatenation'),
  0.7, 'low', 'performance' FROM flags WHERE string_concatenation
UNION ALL
SELECT file_id, CAST(0 AS BIGINT), 'refactoring', 'Code Quality Improvement Needed',
  printf('File has %d code quality issues that should be addressed', code_smells), 0.9, 'medium', 'maintainability'
FROM scores WHERE code_smells > 5
UNION ALL
SELECT file_id, CAST(func_line AS BIGINT), 'refactoring', 'High Complexity in ' || coalesce(func_name, 'anonymous'),
  printf('Function has cyclomatic complexity of %d (recommended: <10)', complexity), 0.9, 'high', 'maintainability'
FROM cyc WHERE complexity > 10"""),
]


def suggestions(spark, sf_dir):
    v = Views(spark, sf_dir)
    files, lines = v("files"), v("file_lines")
    al = R.attach(lines, R.analyzable_files(files), cols=("project_id", "language"))
    sec = R.security_findings(al)
    nested = R.nested_loops(al).withColumn("issue", F.lit("nested_loops")).withColumn("severity", F.lit("medium"))
    concat = (al.where(R.string_concat(F.col("line"))).select("file_id", "line_no")
              .withColumn("issue", F.lit("string_concatenation")).withColumn("severity", F.lit("low")))
    scores = A.file_scores(A.file_issue_counts(files, lines))
    cyc = R.cyclomatic(al.where(F.col("language") == "go").select("file_id", "line_no", "line"))
    return SG.analyzer_suggestions(sec, nested.unionByName(concat), scores, cyc)


@query("rul_suggestions", duckdb_with(["files", "file_lines"], SUG_CTES) + "SELECT * FROM sugg")
def rul_suggestions(spark, sf_dir):
    return suggestions(spark, sf_dir)


@query("flt_suggestions", duckdb_with(["files", "file_lines"], SUG_CTES) + f"""
SELECT * EXCLUDE (r), CAST(r AS BIGINT) AS rank FROM (
  SELECT f.project_id, g.*, row_number() OVER (PARTITION BY f.project_id ORDER BY g.file_id, line, description) AS r
  FROM sugg g JOIN (SELECT file_id, project_id FROM files) f ON g.file_id = f.file_id WHERE category = {sql_str(SUGGESTION_CATEGORY)}) s
WHERE r <= (CASE WHEN TRY_CAST({sql_str(SUGGESTION_LIMIT)} AS BIGINT) BETWEEN 1 AND 1000
  THEN TRY_CAST({sql_str(SUGGESTION_LIMIT)} AS BIGINT) ELSE 50 END)""")
def flt_suggestions(spark, sf_dir):
    """FLT_SUGGESTIONS: of each project one category, first N (N parsed: 1..1000, else 50) -- the limit is the feature."""
    from codelens.operators.process import top_k
    s = suggestions(spark, sf_dir).where(F.col("category") == SUGGESTION_CATEGORY)
    v = int(SUGGESTION_LIMIT) if SUGGESTION_LIMIT.isdigit() else 0
    n = v if 1 <= v <= 1000 else 50
    projects = Views(spark, sf_dir)("files").select("file_id", "project_id")
    return top_k(s.join(projects, "file_id"), ["project_id"], [F.col("file_id"), F.col("line"), F.col("description")], n)
