"""File-kind flags, project JSON export, Python linter JSON, and the output of the stream operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.operators import deps as DP
from codelens.operators import diagnostics as D
from codelens.operators import process as P
from codelens.operators import project as PR
from codelens.operators.rules import todos
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.q_deps import D_NPM
from codelens.plans.q_diagnostics import D_ACTIVE, active_errors
from codelens.plans.q_overview import D_STATE_CTES, STATE_VIEWS, project_state
from codelens.plans.q_project import D_EXT, D_NAME, project_key
from codelens.plans.q_streams import D_CHANGES
from codelens.plans.registry import REGISTRY, Views, query, sql_list
from codelens.session import ensure_checkpoint_dir
from codelens.streaming import watchers as W


def _files(spark, sf_dir):
    return PR.with_file_attrs(Views(spark, sf_dir)("files"))


@query("prj_code_file", duckdb_with(["files"]) + f"""
SELECT file_id, {D_EXT} IN ({sql_list(C.CODE_EXTS)}) AS is_code, {D_EXT} IN ({sql_list(C.ANALYZABLE_EXTS)}) AS is_analyzable FROM files""")
def prj_code_file(spark, sf_dir):
    """PRJ_CODE_FILE: code file (13 extensions) and analyzable file (10 extensions)."""
    return _files(spark, sf_dir).select("file_id", "is_code", "is_analyzable")


MAIN_BY_LANG = "CASE " + " ".join(
    f"WHEN {D_EXT} IN ({sql_list(exts)}) THEN {D_NAME} IN ({sql_list([m.lower() for m in PR.LANGUAGE_MAIN_FILES[k]])})"
    for k, _, exts, _, _ in PR.LANGUAGES) + " ELSE false END"


@query("prj_main_file", duckdb_with(["files"]) + f"""
SELECT file_id, {D_NAME} IN ({sql_list(C.MAIN_FILES)}) AS is_main, {MAIN_BY_LANG} AS is_language_main FROM files""")
def prj_main_file(spark, sf_dir):
    """PRJ_MAIN_FILE: one of 7 global entry names; or an entry name of the file's language."""
    f = _files(spark, sf_dir)
    lang = F.try_element_at(F.create_map(*[F.lit(x) for kv in PR.ext_language_map().items() for x in kv]), F.col("ext_l"))
    mains = F.create_map(*[x for k, v in PR.LANGUAGE_MAIN_FILES.items()
                           for x in (F.lit(k), F.array(*[F.lit(m.lower()) for m in v]))])
    by_lang = F.coalesce(F.array_contains(F.try_element_at(mains, lang), F.col("name_l")), F.lit(False))
    return f.select("file_id", "is_main", by_lang.alias("is_language_main"))


@query("prj_config_file", duckdb_with(["files"]) + f"""
SELECT file_id, {D_NAME} IN ({sql_list(C.CONFIG_FILES)}) AS is_config FROM files""")
def prj_config_file(spark, sf_dir):
    """PRJ_CONFIG_FILE: config file by lower-cased base name (13 names)."""
    return _files(spark, sf_dir).select("file_id", "is_config")


D_ERR = f"""SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, seq, source, file, line_number, "column", type, message FROM ({D_ACTIVE}) a"""


@query("snk_project_json", duckdb_with([*STATE_VIEWS, "file_observations"], [*D_STATE_CTES, D_CHANGES]) + f"""
SELECT project_id, 'state' AS section, to_json({{'health_score': health_score, 'total_files': total_files, 'total_size': total_size, 'languages': languages,
  'primary_language': primary_language, 'project_type': project_type, 'error_count': error_count, 'todo_count': todo_count,
  'dependency_count': dependency_count, 'is_dirty': is_dirty, 'technical_debt': technical_debt}}) AS json FROM st
UNION ALL SELECT project_id, 'language', to_json({{'language': language, 'files': files, 'lines': lines, 'main_files': main_files, 'config_files': config_files}}) FROM langs
UNION ALL SELECT project_id, 'error', to_json({{'seq': seq, 'source': source, 'file': coalesce(file, ''), 'line_number': line_number, 'type': type, 'message': message}}) FROM ({D_ERR}) e
UNION ALL SELECT project_id, 'todo', to_json({{'file': rel_path, 'line_number': CAST(line_no AS BIGINT), 'type': todo_type, 'message': message}}) FROM todos
UNION ALL SELECT 'src' || CAST(project_id % 20 AS VARCHAR), 'dependency', to_json({{'name': name, 'version': version, 'type': type, 'source': source}}) FROM ({D_NPM}) d
UNION ALL SELECT 'src' || regexp_extract(path, '^proj([0-9]+)/', 1), 'change', to_json({{'path': path, 'type': change_type, 'seq': seq}}) FROM changes WHERE change_type IS NOT NULL""")
def snk_project_json(spark, sf_dir):
    """SNK_PROJECT_JSON: a project's whole state as JSON rows by section (state, languages, errors, todos, dependencies, changes).

    Rows, not one text for each project: a writer partitioned by project and
    section gives the export, and no project is gathered in one task."""
    v = Views(spark, sf_dir)

    def rows(df, section, *columns):
        return df.select("project_id", F.lit(section).alias("section"), F.to_json(F.struct(*columns)).alias("json"))

    col = lambda c, name: F.col(c).alias(name)
    errors = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    deps = DP.npm_dependencies(v("manifest_json")).withColumn("project_id", project_key(F.col("project_id")))
    changes = P.file_changes(v("file_observations")).withColumn("project_id", F.concat(F.lit("src"), F.regexp_extract("path", r"^proj([0-9]+)/", 1)))
    parts = [
        rows(project_state(spark, sf_dir), "state", "health_score", "total_files", "total_size", "languages", "primary_language", "project_type",
             "error_count", "todo_count", "dependency_count", "is_dirty", "technical_debt"),
        rows(PR.detected_languages(v("files")), "language", "language", "files", "lines", "main_files", "config_files"),
        rows(errors, "error", "seq", "source", F.coalesce("file", F.lit("")).alias("file"), "line_number", "type", "message"),
        rows(todos(PR.todo_lines(v("files"), v("file_lines"))), "todo", col("rel_path", "file"), F.col("line_no").cast("bigint").alias("line_number"),
             col("todo_type", "type"), "message"),
        rows(deps, "dependency", "name", "version", "type", "source"),
        rows(changes, "change", "path", col("change_type", "type"), "seq"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ------------------------------------------------------------ ERR_PYLINT_RUFF

PYLINT_SCHEMA = ("array<struct<type:string,module:string,obj:string,line:int,column:int,path:string,"
                 "symbol:string,message:string,`message-id`:string>>")
RUFF_SCHEMA = "array<struct<code:string,message:string,filename:string,location:struct<row:int,column:int>>>"


def python_lint_errors(runs):
    """ERR_PYLINT_RUFF: pylint and ruff JSON reports; output that is not JSON goes to the Python pattern scan."""
    p = runs.withColumn("_pl", F.when(F.col("tool") == "pylint", F.from_json("output", PYLINT_SCHEMA))) \
        .withColumn("_rf", F.when(F.col("tool") == "ruff", F.from_json("output", RUFF_SCHEMA)))
    pl = (p.where(F.col("_pl").isNotNull()).select("run_id", F.explode("_pl").alias("m"))
          .select("run_id", F.lit("pylint").alias("source"), F.col("m.path").alias("file"),
                  F.coalesce(F.col("m.line"), F.lit(0)).cast("bigint").alias("line_number"),
                  F.coalesce(F.col("m.column"), F.lit(0)).cast("bigint").alias("column"), F.lit("lint").alias("type"),
                  F.col("m.message").alias("message"), F.col("m.`message-id`").alias("code")))
    rf = (p.where(F.col("_rf").isNotNull()).select("run_id", F.explode("_rf").alias("m"))
          .select("run_id", F.lit("ruff").alias("source"), F.col("m.filename").alias("file"),
                  F.coalesce(F.col("m.location.row"), F.lit(0)).cast("bigint").alias("line_number"),
                  F.coalesce(F.col("m.location.column"), F.lit(0)).cast("bigint").alias("column"), F.lit("lint").alias("type"),
                  F.col("m.message").alias("message"), F.col("m.code").alias("code")))
    bad = p.where(F.col("_pl").isNull() & F.col("_rf").isNull())
    fb = (D.pattern_scan(bad.select("run_id", F.explode(F.split("output", "\n")).alias("line")), "python")
          .select("run_id", "source", "file", "line_number", "column", "type", "message", "code"))
    return pl.unionByName(rf).unionByName(fb)


@query("err_pylint_ruff", duckdb_with(["python_lint_json"]) + f"""
SELECT run_id, 'pylint' AS source, m.path AS file, CAST(coalesce(m.line, 0) AS BIGINT) AS line_number,
  CAST(coalesce(m."column", 0) AS BIGINT) AS column, 'lint' AS type, m.message AS message, m."message-id" AS code
FROM (SELECT run_id, unnest(TRY_CAST(json(output) AS STRUCT(type VARCHAR, module VARCHAR, obj VARCHAR, line INT, "column" INT,
  path VARCHAR, symbol VARCHAR, message VARCHAR, "message-id" VARCHAR)[])) AS m FROM python_lint_json WHERE tool = 'pylint' AND json_valid(output)) a
UNION ALL
SELECT run_id, 'ruff', m.filename, CAST(coalesce(m.location."row", 0) AS BIGINT), CAST(coalesce(m.location."column", 0) AS BIGINT),
  'lint', m.message, m.code
FROM (SELECT run_id, unnest(TRY_CAST(json(output) AS STRUCT(code VARCHAR, message VARCHAR, filename VARCHAR,
  location STRUCT("row" INT, "column" INT))[])) AS m FROM python_lint_json WHERE tool = 'ruff' AND json_valid(output)) b
UNION ALL
SELECT run_id, {duck.first_match_select('python', severity=False)} FROM (
  SELECT run_id, unnest(string_split(output, chr(10))) AS line FROM python_lint_json WHERE NOT json_valid(output)) c
WHERE {duck.first_match_fields('python')['hit']}""")
def err_pylint_ruff(spark, sf_dir):
    return python_lint_errors(Views(spark, sf_dir)("python_lint_json"))


# ------------------------------------------------------------ the stream operators' own output

LOG_COLUMNS = ["seq", "pid", "source", "ts", "line"]
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _streamed(spark, rows, build, mode="append"):
    """What the operator writes when the rows come as several micro-batches."""
    return W.run_through(rows, "seq", build, f"{ensure_checkpoint_dir(spark)}/streams-{uuid.uuid4().hex}", mode)


@query("str_errors", REGISTRY["win_context"][1])
def str_errors(spark, sf_dir):
    """STR_ERRORS: the errors, with context, that the keyed stream writes."""
    out = _streamed(spark, Views(spark, sf_dir)("log_lines").select(*LOG_COLUMNS), W.error_stream)
    return out.select("seq", "pid", "source", "severity", "error_type", "context", "context_lines")


LATEST_SINCE = "24h"  # request text; unparsable text falls back to 5 minutes


@query("str_latest", REGISTRY["win_last_error"][1])  # same rows as the 1440-minute window
def str_latest(spark, sf_dir):
    """STR_LATEST: the last row that the stream gave out for each process, where newer than ``as_of - since`` (parsed from text)."""
    lines = Views(spark, sf_dir)("log_lines").select(*LOG_COLUMNS)
    last = P.latest_per_key(_streamed(spark, lines, W.latest_errors, "update").drop("epoch"), ["pid"])
    minutes = P.parse_duration_minutes(F.lit(LATEST_SINCE))
    cutoff = lines.select(F.max("ts")).scalar() - F.make_dt_interval(secs=minutes * 60)
    return last.where(F.col("ts") > cutoff).select("pid", "seq", "severity", "error_type", "message", F.date_format("ts", TS_FORMAT).alias("ts"))


@query("str_changes", REGISTRY["win_changes"][1])
def str_changes(spark, sf_dir):
    """STR_CHANGES: created / modified as the keyed stream writes them."""
    out = _streamed(spark, Views(spark, sf_dir)("file_observations"), W.change_stream)
    return out.select("seq", "path", "change_type", F.date_format("mtime", TS_FORMAT).alias("mtime"))


@query("str_process_state", duckdb_with(["log_lines"]) + f"""
SELECT a.pid, a.lines, a.errors, a.last_error, a.last_seq, sha256(t.tail) AS tail_sha256 FROM (
  SELECT pid, CAST(count(*) AS BIGINT) AS lines, CAST(count_if(err) AS BIGINT) AS errors,
    arg_max(line, seq) FILTER (WHERE err) AS last_error, max(seq) AS last_seq
  FROM (SELECT *, {duck.process_gate()} AS err FROM log_lines) x GROUP BY pid) a
JOIN (SELECT pid, string_agg(line, chr(10) ORDER BY seq) AS tail FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq DESC) AS r FROM log_lines) y WHERE r <= {C.MAX_OUTPUT_LINES} GROUP BY pid) t USING (pid)""")
def str_process_state(spark, sf_dir):
    """STR_PROCESS_STATE: the last row that the stream gave out for each process, with the digest of the kept lines."""
    out = _streamed(spark, Views(spark, sf_dir)("log_lines").select(*LOG_COLUMNS), W.process_state, "update")
    last = P.latest_per_key(out.drop("epoch"), ["pid"], "lines")  # a process's line count only grows
    return last.select("pid", "lines", "errors", "last_error", "last_seq", F.sha2("tail", 256).alias("tail_sha256"))
