"""Diagnostics queries: tool output, lint reports, tracebacks, process output, tests, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.text import map_lookup
from codelens.operators import diagnostics as D
from codelens.operators import ops as O
from codelens.operators import process as P
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.registry import Views, query, sql_str

ERR_OUT = ["source", "file", "line_number", "column", "type", "message", "code"]
TOOL_LANG_CASE = "CASE tool " + " ".join(
    f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in C.TOOL_LANGUAGE.items()) + " END"


def _tool(spark, sf_dir, tool: str | None = None) -> DataFrame:
    t = Views(spark, sf_dir)("tool_output")
    return t if tool is None else t.where(F.col("tool") == tool)


def _tool_lang(spark, sf_dir) -> DataFrame:
    return _tool(spark, sf_dir).withColumn("language", map_lookup(C.TOOL_LANGUAGE, F.col("tool")))


def _errs(df: DataFrame, extra=()) -> DataFrame:
    return df.select("seq", "project_id", *ERR_OUT, *extra)


def active_errors(spark, sf_dir) -> DataFrame:
    """Core watcher errors: tsc (error TS lines), go build, and a keyword scan of other captured output."""
    t = _tool(spark, sf_dir)
    ts = D.tsc_core_errors(t.where(F.col("tool") == "tsc"))
    go = D.go_build_errors(t.where(F.col("tool") == "go"))
    logs = D.log_keyword_errors(t.where(~F.col("tool").isin("tsc", "go")))
    return _errs(ts).unionByName(_errs(go)).unionByName(_errs(logs))


D_ACTIVE = f"""
SELECT seq, project_id, 'typescript' AS source, {duck.extract('line', r'(.+)\((\d+),(\d+)\): error (TS\d+): (.+)', 1)} AS file,
  {duck.to_int(duck.extract('line', r'(.+)\((\d+),(\d+)\): error (TS\d+): (.+)', 2))} AS line_number,
  {duck.to_int(duck.extract('line', r'(.+)\((\d+),(\d+)\): error (TS\d+): (.+)', 3))} AS column, 'error' AS type,
  {duck.extract('line', r'(.+)\((\d+),(\d+)\): error (TS\d+): (.+)', 5)} AS message,
  {duck.extract('line', r'(.+)\((\d+),(\d+)\): error (TS\d+): (.+)', 4)} AS code
FROM tool_output WHERE tool = 'tsc' AND contains(line, 'error TS') AND {duck.matches('line', r'(.+)\((\d+),(\d+)\): error (TS\d+): (.+)')}
UNION ALL
SELECT seq, project_id, 'go', {duck.extract('line', r'(.+\.go):(\d+):(\d+): (.+)', 1)},
  {duck.to_int(duck.extract('line', r'(.+\.go):(\d+):(\d+): (.+)', 2))},
  {duck.to_int(duck.extract('line', r'(.+\.go):(\d+):(\d+): (.+)', 3))}, 'error',
  {duck.extract('line', r'(.+\.go):(\d+):(\d+): (.+)', 4)}, ''
FROM tool_output WHERE tool = 'go' AND contains(line, '.go:') AND contains(line, 'error') AND {duck.matches('line', r'(.+\.go):(\d+):(\d+): (.+)')}
UNION ALL
SELECT seq, project_id, 'runtime', NULL, 0, 0, 'error', line, ''
FROM tool_output WHERE tool NOT IN ('tsc', 'go') AND (contains(lower(line), 'error') OR contains(lower(line), 'exception') OR contains(lower(line), 'fatal'))
"""


def d_tool(body: str, ctes=()) -> str:
    return duckdb_with(["tool_output"], list(ctes)) + body


# ------------------------------------------------------------ compiler / linter text

TSC = r"(.+)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)"


@query("err_tsc", d_tool(f"""
SELECT seq, project_id, 'tsc' AS source, {duck.extract('t', TSC, 1)} AS file,
  {duck.to_int(duck.extract('t', TSC, 2))} AS line_number, {duck.to_int(duck.extract('t', TSC, 3))} AS column,
  CASE WHEN contains({duck.extract('t', TSC, 6)}, 'Cannot find module') THEN 'import'
       WHEN contains({duck.extract('t', TSC, 6)}, 'syntax') THEN 'syntax' ELSE 'type' END AS type,
  {duck.extract('t', TSC, 6)} AS message, {duck.extract('t', TSC, 5)} AS code
FROM (SELECT *, {duck.trim('line')} AS t FROM tool_output WHERE tool = 'tsc') s WHERE {duck.matches('t', TSC)}"""))
def err_tsc(spark, sf_dir):
    return _errs(D.tsc_errors(_tool(spark, sf_dir, "tsc")))


@query("err_go_build", d_tool(f"""
SELECT * FROM ({D_ACTIVE}) a WHERE source = 'go'"""))
def err_go_build(spark, sf_dir):
    return _errs(D.go_build_errors(_tool(spark, sf_dir, "go")))


FLAKE8 = r"(.+):(\d+):(\d+): (\w+) (.+)"
MYPY = r"(.+):(\d+): (error|warning|note): (.+)"


@query("err_flake8", d_tool(f"""
SELECT seq, project_id, 'flake8' AS source, {duck.extract('line', FLAKE8, 1)} AS file,
  {duck.to_int(duck.extract('line', FLAKE8, 2))} AS line_number, {duck.to_int(duck.extract('line', FLAKE8, 3))} AS column,
  'lint' AS type, {duck.extract('line', FLAKE8, 5)} AS message, {duck.extract('line', FLAKE8, 4)} AS code
FROM tool_output WHERE tool = 'flake8' AND {duck.matches('line', FLAKE8)}"""))
def err_flake8(spark, sf_dir):
    return _errs(D.flake8_errors(_tool(spark, sf_dir, "flake8")))


@query("err_mypy", d_tool(f"""
SELECT seq, project_id, 'mypy' AS source, {duck.extract('line', MYPY, 1)} AS file,
  {duck.to_int(duck.extract('line', MYPY, 2))} AS line_number, CAST(0 AS BIGINT) AS column,
  'type' AS type, {duck.extract('line', MYPY, 4)} AS message, '' AS code,
  CASE WHEN {duck.extract('line', MYPY, 3)} = 'note' THEN 'info' ELSE {duck.extract('line', MYPY, 3)} END AS severity
FROM tool_output WHERE tool = 'mypy' AND {duck.matches('line', MYPY)}"""))
def err_mypy(spark, sf_dir):
    return _errs(D.mypy_errors(_tool(spark, sf_dir, "mypy")), extra=["severity"])


@query("err_log_keywords", duckdb_with(["log_lines"]) + """
SELECT seq, pid, 'runtime' AS source, 'error' AS type, line AS message FROM log_lines
WHERE contains(lower(line), 'error') OR contains(lower(line), 'exception') OR contains(lower(line), 'fatal')""")
def err_log_keywords(spark, sf_dir):
    lines = Views(spark, sf_dir)("log_lines").withColumnRenamed("source", "pipe")
    return D.log_keyword_errors(lines).select("seq", "pid", "source", "type", "message")


def _d_scan_by_lang() -> str:
    parts = []
    for lang in C.LANGUAGE_PATTERNS:
        parts.append(f"""SELECT seq, project_id, tool, {duck.first_match_select(lang)}
FROM tl WHERE language = {sql_str(lang)} AND {duck.first_match_fields(lang)['hit']}""")
    return "\nUNION ALL\n".join(parts)


TL_CTE = ("tl", f"SELECT *, {TOOL_LANG_CASE} AS language FROM tool_output")


@query("err_pattern_scan", d_tool(_d_scan_by_lang(), [TL_CTE]))
def err_pattern_scan(spark, sf_dir):
    s = D.pattern_scan_by_language(_tool_lang(spark, sf_dir))
    return s.select("seq", "project_id", "tool", *ERR_OUT[:5], "severity", "message", "code")


@query("err_build_output", d_tool(_d_scan_by_lang() + f"""
UNION ALL
SELECT seq, project_id, tool, {duck.first_match_select('javascript')}
FROM tl WHERE language = 'typescript' AND {duck.first_match_fields('javascript')['hit']}""", [TL_CTE]))
def err_build_output(spark, sf_dir):
    s = D.build_output_errors(_tool_lang(spark, sf_dir))
    return s.select("seq", "project_id", "tool", *ERR_OUT[:5], "severity", "message", "code")


@query("err_file_scan", duckdb_with(["log_lines"]) + f"""
SELECT pid, CAST(line_no AS BIGINT) AS line_no, concat(CAST(pid AS VARCHAR), '.log') AS file,
  {duck.first_match_fields('javascript')['type']} AS type, {duck.trim('line')} AS message
FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq) AS line_no FROM log_lines) s
WHERE {duck.first_match_fields('javascript')['hit']}""")
def err_file_scan(spark, sf_dir):
    """Each process log (pid) scanned as a file: line numbers, trimmed message, file = base name."""
    from codelens.functions.windows import dense_index
    lines = dense_index(Views(spark, sf_dir)("log_lines"), ["pid"], "seq", out="line_no")
    s = D.pattern_scan(lines, "javascript", trim_message=True)
    return s.select("pid", "line_no", F.concat(F.col("pid").cast("string"), F.lit(".log")).alias("file"),
                    "type", "message")


# ------------------------------------------------------------ lint JSON

def _lint(spark, sf_dir, tool):
    return Views(spark, sf_dir)("lint_json").where(F.col("tool") == tool)


D_ESLINT = f"""
SELECT run_id, 'eslint' AS source, r.filePath AS file, CAST(coalesce(m.line, 0) AS BIGINT) AS line_number,
  CAST(coalesce(m.column, 0) AS BIGINT) AS column, 'lint' AS type, m.message AS message, m.ruleId AS code
FROM (SELECT run_id, unnest(j) AS r FROM (SELECT run_id,
   TRY_CAST(json(output) AS STRUCT(filePath VARCHAR, messages STRUCT(ruleId VARCHAR, severity INT, message VARCHAR, line INT, "column" INT)[])[]) AS j
   FROM lint_json WHERE tool = 'eslint' AND json_valid(output)) s) u, LATERAL (SELECT unnest(u.r.messages) AS m) mm
UNION ALL
SELECT run_id, {duck.first_match_select('javascript', severity=False)}
FROM (SELECT run_id, unnest(string_split(output, chr(10))) AS line FROM lint_json WHERE tool = 'eslint' AND NOT json_valid(output)) t
WHERE {duck.first_match_fields('javascript')['hit']}"""


@query("err_eslint", duckdb_with(["lint_json"]) + f"SELECT * FROM ({D_ESLINT}) e")
def err_eslint(spark, sf_dir):
    return D.eslint_errors(_lint(spark, sf_dir, "eslint")).select("run_id", *ERR_OUT)


D_TSLINT = f"""
SELECT run_id, 'tslint' AS source, r.name AS file, CAST(coalesce(r.startPosition.line, 0) + 1 AS BIGINT) AS line_number,
  CAST(coalesce(r.startPosition.character, 0) + 1 AS BIGINT) AS column, 'lint' AS type, r.failure AS message, r.ruleName AS code
FROM (SELECT run_id, unnest(TRY_CAST(json(output) AS STRUCT(name VARCHAR, ruleName VARCHAR,
   startPosition STRUCT(line INT, "character" INT), failure VARCHAR)[])) AS r
   FROM lint_json WHERE tool = 'tslint' AND json_valid(output)) u
UNION ALL
SELECT run_id, {duck.first_match_select('typescript', severity=False)}
FROM (SELECT run_id, unnest(string_split(output, chr(10))) AS line FROM lint_json WHERE tool = 'tslint' AND NOT json_valid(output)) t
WHERE {duck.first_match_fields('typescript')['hit']}"""


@query("err_tslint", duckdb_with(["lint_json"]) + f"SELECT * FROM ({D_TSLINT}) e")
def err_tslint(spark, sf_dir):
    return D.tslint_errors(_lint(spark, sf_dir, "tslint")).select("run_id", *ERR_OUT)


@query("err_ts_js_only", duckdb_with(["lint_json"]) + f"""
SELECT * FROM ({D_TSLINT}) t
UNION ALL
SELECT * FROM ({D_ESLINT}) e WHERE suffix(file, '.js') OR suffix(file, '.jsx')""")
def err_ts_js_only(spark, sf_dir):
    """TypeScript errors plus the JavaScript errors of .js/.jsx files."""
    ts = D.tslint_errors(_lint(spark, sf_dir, "tslint")).select("run_id", *ERR_OUT)
    js = D.eslint_errors(_lint(spark, sf_dir, "eslint")).select("run_id", *ERR_OUT)
    js = js.where(F.col("file").endswith(".js") | F.col("file").endswith(".jsx"))
    return ts.unionByName(js)


# ------------------------------------------------------------ whole-run parsers

PY_ERR = r"(SyntaxError|IndentationError): (.+)"
PY_FILE = r'File "(.+)", line (\d+)'


@query("err_py_traceback", duckdb_with(["traceback_lines"]) + f"""
, fe AS (SELECT run_id, arg_min({duck.extract('line', PY_ERR, 1)} || ': ' || {duck.extract('line', PY_ERR, 2)}, seq) AS message,
     min(seq) AS eseq FROM traceback_lines WHERE {duck.matches('line', PY_ERR)} GROUP BY run_id),
lf AS (SELECT t.run_id, arg_max({duck.extract('t.line', PY_FILE, 1)}, t.seq) AS file,
     arg_max({duck.extract('t.line', PY_FILE, 2)}, t.seq) AS ln
     FROM traceback_lines t JOIN fe ON t.run_id = fe.run_id AND t.seq < fe.eseq
     WHERE {duck.matches('t.line', PY_FILE)} GROUP BY t.run_id)
SELECT fe.run_id, 'python' AS source, lf.file, {duck.to_int('lf.ln')} AS line_number, 'syntax' AS type, fe.message
FROM fe JOIN lf USING (run_id) WHERE lf.file <> ''""")
def err_py_traceback(spark, sf_dir):
    return D.python_syntax_errors(Views(spark, sf_dir)("traceback_lines"))


NODE_MSG = r"SyntaxError: (.+)"
NODE_LOC = r"at .*:(\d+):(\d+)"


@query("err_node_syntax", duckdb_with(["traceback_lines"]) + f"""
, m AS (SELECT run_id, arg_min({duck.extract('line', NODE_MSG, 1)}, seq) AS message FROM traceback_lines
        WHERE {duck.matches('line', NODE_MSG)} GROUP BY run_id),
l AS (SELECT run_id, arg_min({duck.extract('line', NODE_LOC, 1)}, seq) AS l, arg_min({duck.extract('line', NODE_LOC, 2)}, seq) AS c
      FROM traceback_lines WHERE {duck.matches('line', NODE_LOC)} GROUP BY run_id)
SELECT m.run_id, 'node' AS source, {duck.to_int('l.l')} AS line_number, {duck.to_int('l.c')} AS column,
  'syntax' AS type, m.message FROM m LEFT JOIN l USING (run_id)""")
def err_node_syntax(spark, sf_dir):
    return D.node_syntax_errors(Views(spark, sf_dir)("traceback_lines"))


# ------------------------------------------------------------ active errors, health

@query("err_all", d_tool(f"""
SELECT * FROM ({D_ACTIVE}) a
UNION ALL
SELECT seq, project_id, 'tsc', {duck.extract('t', TSC, 1)}, {duck.to_int(duck.extract('t', TSC, 2))},
  {duck.to_int(duck.extract('t', TSC, 3))},
  CASE WHEN contains({duck.extract('t', TSC, 6)}, 'Cannot find module') THEN 'import'
       WHEN contains({duck.extract('t', TSC, 6)}, 'syntax') THEN 'syntax' ELSE 'type' END,
  {duck.extract('t', TSC, 6)}, {duck.extract('t', TSC, 5)}
FROM (SELECT *, {duck.trim('line')} AS t FROM tool_output WHERE tool = 'tsc') s WHERE {duck.matches('t', TSC)}
UNION ALL
SELECT seq, project_id, 'flake8', {duck.extract('line', FLAKE8, 1)}, {duck.to_int(duck.extract('line', FLAKE8, 2))},
  {duck.to_int(duck.extract('line', FLAKE8, 3))}, 'lint', {duck.extract('line', FLAKE8, 5)}, {duck.extract('line', FLAKE8, 4)}
FROM tool_output WHERE tool = 'flake8' AND {duck.matches('line', FLAKE8)}
UNION ALL
SELECT seq, project_id, 'mypy', {duck.extract('line', MYPY, 1)}, {duck.to_int(duck.extract('line', MYPY, 2))}, 0,
  'type', {duck.extract('line', MYPY, 4)}, ''
FROM tool_output WHERE tool = 'mypy' AND {duck.matches('line', MYPY)}
""" + "".join(f"""UNION ALL
SELECT seq, project_id, {duck.first_match_select(lang, severity=False)} FROM tool_output
WHERE tool IN ({tools}) AND {duck.first_match_fields(lang)['hit']}
""" for lang, tools in (("go", "'go', 'gotest'"), ("java", "'javac'"), ("javascript", "'jest'"), ("python", "'pytest', 'unittest'")))))
def err_all(spark, sf_dir):
    """Active errors plus the plug-in errors of every language's captured output (duplicates kept)."""
    t = _tool(spark, sf_dir)
    plug = (_errs(D.tsc_errors(t.where(F.col("tool") == "tsc")))
            .unionByName(_errs(D.flake8_errors(t.where(F.col("tool") == "flake8"))))
            .unionByName(_errs(D.mypy_errors(t.where(F.col("tool") == "mypy")))))
    # tools without a parser of their own: the pattern scan of their language
    rest = t.where(F.col("tool").isin("go", "gotest", "javac", "jest", "pytest", "unittest"))
    by_tool = F.create_map(*[F.lit(x) for kv in C.TOOL_LANGUAGE.items() for x in kv])
    plug = plug.unionByName(_errs(D.pattern_scan_by_language(rest.withColumn("language", F.try_element_at(by_tool, F.col("tool"))))))
    return active_errors(spark, sf_dir).unionByName(plug)


@query("agg_health", d_tool(f"""
SELECT p.project_id, CAST(greatest(0, 100 - 10 * coalesce(e, 0) - 3 * coalesce(w, 0)) AS BIGINT) AS score,
  CAST(coalesce(e, 0) AS BIGINT) AS error_count, CAST(coalesce(w, 0) AS BIGINT) AS warning_count,
  CASE WHEN coalesce(e, 0) > 10 OR coalesce(w, 0) > 50 THEN 'high'
       WHEN coalesce(e, 0) > 5 OR coalesce(w, 0) > 20 THEN 'medium' ELSE 'low' END AS technical_debt,
  CASE WHEN greatest(0, 100 - 10 * coalesce(e, 0) - 3 * coalesce(w, 0)) >= 80 THEN 'healthy'
       WHEN greatest(0, 100 - 10 * coalesce(e, 0) - 3 * coalesce(w, 0)) >= 50 THEN 'warning' ELSE 'error' END AS band
FROM (SELECT DISTINCT project_id FROM tool_output) p
LEFT JOIN (SELECT project_id, count_if(type = 'error') AS e, count_if(type = 'warning') AS w
           FROM ({D_ACTIVE}) a GROUP BY project_id) c USING (project_id)"""))
def agg_health(spark, sf_dir):
    projects = _tool(spark, sf_dir).select("project_id").distinct()
    h = D.health(active_errors(spark, sf_dir), projects)
    return h.withColumn("band", D.health_band(F.col("score")))


@query("agg_errors_by_file", d_tool(f"""
SELECT project_id, coalesce(nullif(file, ''), 'unknown') AS file, CAST(count(*) AS BIGINT) AS errors,
  CAST(min(line_number) AS BIGINT) AS first_line, CAST(max(line_number) AS BIGINT) AS last_line
FROM ({D_ACTIVE}) a GROUP BY ALL"""))
def agg_errors_by_file(spark, sf_dir):
    e = active_errors(spark, sf_dir)
    return (e.groupBy("project_id", F.coalesce(F.nullif(F.col("file"), F.lit("")), F.lit("unknown")).alias("file"))
            .agg(F.count(F.lit(1)).alias("errors"), F.min("line_number").alias("first_line"),
                 F.max("line_number").alias("last_line")))


# ------------------------------------------------------------ tests

@query("tst_go", d_tool("""
SELECT project_id, CAST(count_if(contains(line, 'PASS')) AS BIGINT) AS passed,
  CAST(count_if(NOT contains(line, 'PASS') AND contains(line, 'FAIL')) AS BIGINT) AS failed,
  CAST(count_if(contains(line, 'PASS')) + count_if(NOT contains(line, 'PASS') AND contains(line, 'FAIL')) AS BIGINT) AS total
FROM tool_output WHERE tool = 'gotest' GROUP BY project_id"""))
def tst_go(spark, sf_dir):
    return D.go_test_counts(_tool(spark, sf_dir, "gotest"), ["project_id"])


@query("tst_pytest", d_tool(f"""
SELECT project_id, {duck.to_int(duck.extract('l', r'(\d+) failed'))} AS failed, {duck.to_int(duck.extract('l', r'(\d+) passed'))} AS passed,
  {duck.to_int(duck.extract('l', r'(\d+) failed'))} + {duck.to_int(duck.extract('l', r'(\d+) passed'))} AS total
FROM (SELECT project_id, arg_max(line, seq) AS l FROM tool_output WHERE tool = 'pytest' AND contains(line, 'passed') AND contains(line, 'failed')
      GROUP BY project_id) s"""))
def tst_pytest(spark, sf_dir):
    return D.pytest_summary(_tool(spark, sf_dir, "pytest"), ["project_id"])


@query("tst_jest", d_tool(f"""
SELECT project_id, {duck.to_int(duck.extract('l', r'(\d+) failed'))} AS failed, {duck.to_int(duck.extract('l', r'(\d+) passed'))} AS passed,
  {duck.to_int(duck.extract('l', r'(\d+) total'))} AS total
FROM (SELECT project_id, arg_max(line, seq) AS l FROM tool_output WHERE tool = 'jest' AND contains(line, 'Tests:') AND contains(line, 'total')
      GROUP BY project_id) s"""))
def tst_jest(spark, sf_dir):
    return D.jest_summary(_tool(spark, sf_dir, "jest"), ["project_id"])


@query("tst_unittest", d_tool("""
SELECT project_id, tool, CAST(CASE WHEN bool_or(contains(line, 'OK')) THEN 1 ELSE 0 END AS BIGINT) AS passed,
  CAST(CASE WHEN NOT bool_or(contains(line, 'OK')) AND bool_or(contains(line, 'FAILED')) THEN 1 ELSE 0 END AS BIGINT) AS failed,
  CAST(CASE WHEN bool_or(contains(line, 'OK')) OR bool_or(contains(line, 'FAILED')) THEN 1 ELSE 0 END AS BIGINT) AS total
FROM tool_output GROUP BY project_id, tool"""))
def tst_unittest(spark, sf_dir):
    return D.unittest_summary(_tool(spark, sf_dir), ["project_id", "tool"])


# ------------------------------------------------------------ process output

def _log(spark, sf_dir):
    return Views(spark, sf_dir)("log_lines")


D_CLASSIFIED = f"""SELECT seq, pid, source, ts, line, {duck.severity_expr()} AS severity, {duck.error_type_expr()} AS error_type
FROM log_lines WHERE {duck.process_gate()}"""


@query("err_classify", duckdb_with(["log_lines"]) + f"""
SELECT seq, pid, source, severity, error_type, line AS message FROM ({D_CLASSIFIED}) c""")
def err_classify(spark, sf_dir):
    return D.classify_process_lines(_log(spark, sf_dir)).select("seq", "pid", "source", "severity", "error_type", "message")


@query("win_context", duckdb_with(["log_lines"]) + f"""
SELECT seq, pid, source, severity, error_type, context, CAST(context_lines AS BIGINT) AS context_lines FROM (
  SELECT *, {duck.severity_expr()} AS severity, {duck.error_type_expr()} AS error_type,
    concat_ws(chr(10), lag(line, 4) OVER w, lag(line, 3) OVER w, lag(line, 2) OVER w, lag(line, 1) OVER w, line) AS context,
    count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context_lines
  FROM log_lines WINDOW w AS (PARTITION BY pid, source ORDER BY seq)) s
WHERE {duck.process_gate()}""")
def win_context(spark, sf_dir):
    c = P.with_context(_log(spark, sf_dir))
    return c.select("seq", "pid", "source", "severity", "error_type", F.array_join("context", "\n").alias("context"),
                    F.size("context").cast("bigint").alias("context_lines"))


@query("win_tail", duckdb_with(["log_lines"]) + """
SELECT pid, seq, line, CAST(from_end AS BIGINT) AS from_end FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq DESC) AS from_end FROM log_lines) s WHERE from_end <= 50""")
def win_tail(spark, sf_dir):
    return P.tail(_log(spark, sf_dir), ["pid"], n=C.DEFAULT_TAIL).select("pid", "seq", "line", "from_end")


@query("win_retain", duckdb_with(["log_lines"]) + """
SELECT pid, seq, CAST(from_end AS BIGINT) AS from_end FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq DESC) AS from_end FROM log_lines) s WHERE from_end <= 10000""")
def win_retain(spark, sf_dir):
    return P.tail(_log(spark, sf_dir), ["pid"], n=C.MAX_OUTPUT_LINES).select("pid", "seq", "from_end")


@query("win_last_error", duckdb_with(["log_lines"]) + f"""
SELECT pid, seq, severity, error_type, line AS message, {duck.ts_text('ts')} AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq DESC) AS r FROM ({D_CLASSIFIED}) c) s
WHERE r = 1 AND ts > (SELECT max(ts) FROM log_lines) - INTERVAL 1440 MINUTES""")
def win_last_error(spark, sf_dir):
    lines = _log(spark, sf_dir)
    errs = D.classify_process_lines(lines).select("pid", "seq", "severity", "error_type", "message", "ts")
    last = P.latest_errors(errs, 1440, as_of=lines.select(F.max("ts")).scalar())
    return last.select("pid", "seq", "severity", "error_type", "message",
                       F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("udx_patterns", duckdb_with(["log_lines"]) + f"""
SELECT seq, pid, source, {duck.severity_expr()} AS severity, {duck.error_type_expr()} AS error_type, line AS message
FROM log_lines WHERE {duck.process_gate()} OR (pid IN (SELECT c_custkey FROM customer)
  AND (pid % 2 = 0 AND regexp_matches(line, 'heartbeat|cache warm') OR pid % 3 = 0 AND regexp_matches(line, 'GET[ ]/index')))""")
def udx_patterns(spark, sf_dir):
    """Per-process user patterns: customers' processes add one to three patterns to the default gate (one of them no valid regex)."""
    lines = _log(spark, sf_dir)
    pid = F.col("c_custkey")
    user = Views(spark, sf_dir)("customer").select(pid.alias("pid"), F.explode(F.filter(F.array(
        F.when(pid % 2 == 0, "heartbeat|cache warm"), F.when(pid % 3 == 0, r"GET\s/index"), F.when(pid % 5 == 0, "broken(")),
        lambda p: p.isNotNull())).alias("pattern"))
    return (D.classify_with_user_patterns(lines, user)
            .select("seq", "pid", "source", "severity", "error_type", "message"))


@query("udx_many_patterns", duckdb_with(["log_lines"]) + f"""
, lists AS (SELECT DISTINCT pid, n FROM (SELECT DISTINCT pid FROM log_lines) p JOIN (SELECT p_partkey AS n FROM part) s ON s.n % 7 = p.pid % 7)
SELECT seq, pid, source, {duck.severity_expr()} AS severity, {duck.error_type_expr()} AS error_type, line AS message
FROM log_lines l WHERE {duck.process_gate()} OR EXISTS (SELECT 1 FROM lists n WHERE n.pid = l.pid AND (
  n.n % 11 = 0 AND contains(line, 'listening on port ' || CAST(n.n * 8 % 4000 AS VARCHAR)) OR n.n % 11 = 1 AND contains(line, 'GET /index ' || CAST(n.n AS VARCHAR))
  OR n.n % 11 = 2 AND regexp_matches(line, 'done in [0-9]s') AND n.n % 3 = 0))""")
def udx_many_patterns(spark, sf_dir):
    """Processes with as many patterns of their own as a seventh of ``part`` has rows, most of which no line matches."""
    views, n = Views(spark, sf_dir), F.col("p_partkey")
    pattern = (F.when(n % 11 == 0, F.concat(F.lit("listening on port "), (n * 8 % 4000).cast("string")))
               .when(n % 11 == 1, F.concat(F.lit(r"GET\s/index "), n.cast("string")))
               .when((n % 11 == 2) & (n % 3 == 0), F.lit("done in [0-9]s"))
               .otherwise(F.concat(F.lit("no such line "), n.cast("string"))))
    lines = _log(spark, sf_dir)
    members = lines.select("pid").distinct().select("pid", (F.col("pid") % 7).alias("list"))
    own = views("part").select((n % 7).alias("list"), pattern.alias("pattern")).distinct()
    return D.classify_with_user_patterns(lines, own, members=members).select("seq", "pid", "source", "severity", "error_type", "message")


def _server_hits() -> str:
    """A line that a process's default patterns find: the process's command names the set."""
    sets = [f"command = {sql_str(k)} AND ({' OR '.join(f'contains(line, {sql_str(p)})' for p in C.DEV_SERVER_PATTERNS[k])})" for k in ("npm", "go", "python")]
    return " OR ".join(f"({x})" for x in sets)


@query("udx_dev_server_patterns", duckdb_with(["log_lines", "process_requests"]) + f"""
SELECT seq, pid, source, {duck.severity_expr()} AS severity, {duck.error_type_expr()} AS error_type, line AS message
FROM log_lines l LEFT JOIN process_requests r ON r.req_id = l.pid WHERE {duck.process_gate()} OR {_server_hits()}""")
def udx_dev_server_patterns(spark, sf_dir):
    """Error lines by the default patterns and by those of the dev server that the process was started as."""
    servers = Views(spark, sf_dir)("process_requests").select(F.col("req_id").alias("pid"), F.col("command").alias("kind"))
    hits = D.classify_with_user_patterns(_log(spark, sf_dir), O.dev_server_patterns(servers))
    return hits.select("seq", "pid", "source", "severity", "error_type", "message")
