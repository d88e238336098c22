"""Project structure queries: scopes, languages, directories, structure, todos, search, stats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.text import file_ext, map_lookup
from codelens.operators import deps as DP
from codelens.operators import project as PR
from codelens.operators import rules as R
from codelens.operators.diagnostics import health
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.q_deps import D_NPM, D_PKG, D_TEXT_FW
from codelens.plans.q_diagnostics import D_ACTIVE, active_errors
from codelens.plans.registry import Views, query, sql_list, sql_str

SEARCH_TERM = "o"
FILE_GET_PATH = "src/f0.go"

D_EXT = r"lower(regexp_extract(rel_path, '(\.[^./]*)$', 1))"
D_PARTS = "string_split(rel_path, '/')"
D_DIRS = f"list_slice({D_PARTS}, 1, len({D_PARTS}) - 1)"
D_NAME = f"lower({D_PARTS}[-1])"
D_STRUCT = (f"(len(list_filter({D_PARTS}, lambda s: starts_with(s, '.') AND s NOT IN ({sql_list(C.STRUCTURE_KEEP_DOTNAMES)}))) = 0 "
            f"AND len(list_filter({D_DIRS}, lambda s: s IN ({sql_list(C.STRUCTURE_SKIP_DIRS)}))) = 0)")
D_LANGSCOPE = (f"(len(list_filter({D_DIRS}, lambda s: (starts_with(s, '.') AND s <> '.env') "
               f"OR s IN ({sql_list(PR.LANGUAGE_SKIP_DIRS)}))) = 0)")
D_PLUGSCOPE = f"(len(list_filter({D_DIRS}, lambda s: s IN ({sql_list(PR.PLUGIN_SKIP_DIRS)}))) = 0)"
D_NL = "(length(content) - length(replace(content, chr(10), '')))"
D_SCANNER = f"CAST({D_NL} + CASE WHEN length(content) > 0 AND NOT suffix(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"
D_SPLIT = f"CAST({D_NL} + 1 AS BIGINT)"


def d_case(mapping: dict, x: str, default: str | None) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {sql_str(default) if default is not None else 'NULL'} END"


def _files(spark, sf_dir):
    return Views(spark, sf_dir)("files")


def d_files(body: str, ctes=()) -> str:
    return duckdb_with(["files"], list(ctes)) + body


D_PYSCOPE = "(" + D_PLUGSCOPE + "".join(f" AND NOT contains(rel_path, {sql_str(s)})" for s in PR.PYTHON_DROP) + ")"
D_JSSCOPE = "(" + D_PLUGSCOPE + "".join(f" AND NOT contains(rel_path, {sql_str(s)})" for s in PR.JS_DROP) + ")"


@query("src_scope", d_files(f"""
SELECT file_id, rel_path, {D_STRUCT} AS in_structure, {D_LANGSCOPE} AS in_languages, {D_PLUGSCOPE} AS in_plugin,
  {D_PYSCOPE} AS in_python_plugin, {D_JSSCOPE} AS in_js_plugin FROM files"""))
def src_scope(spark, sf_dir):
    """SRC_SCOPE: the five ignore rules as predicates on path elements (one column per scope)."""
    p = F.col("rel_path")
    return _files(spark, sf_dir).select("file_id", "rel_path", PR.structure_scope(p).alias("in_structure"),
                                        PR.language_scope(p).alias("in_languages"), PR.plugin_scope(p).alias("in_plugin"),
                                        PR.python_plugin_scope(p).alias("in_python_plugin"),
                                        PR.js_plugin_scope(p).alias("in_js_plugin"))


@query("src_ext_list", d_files(f"""
SELECT file_id, rel_path, {D_EXT} AS ext FROM files WHERE {D_EXT} IN ('.py', '.go') AND {D_PLUGSCOPE}"""))
def src_ext_list(spark, sf_dir):
    p = F.col("rel_path")
    return (_files(spark, sf_dir).where(file_ext(p).isin(".py", ".go") & PR.plugin_scope(p))
            .select("file_id", "rel_path", file_ext(p).alias("ext")))


@query("src_lines", duckdb_with(["file_lines"]) + """
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, CAST(strlen(line) AS BIGINT) AS bytes FROM file_lines""")
def src_lines(spark, sf_dir):
    """SRC_LINES: the exploded (file, line_no, line) table, here with byte lengths."""
    lines = Views(spark, sf_dir)("file_lines")
    return lines.select("file_id", F.col("line_no").cast("bigint").alias("line_no"),
                        F.octet_length("line").cast("bigint").alias("bytes"))


@query("prj_language", d_files(f"""
SELECT file_id, {D_EXT} AS ext, {d_case(C.CORE_LANGUAGES, D_EXT, 'text')} AS core_language,
  {d_case(C.ANALYZER_LANGUAGES, D_EXT, 'unknown')} AS analyzer_language,
  {d_case(PR.SUGGESTION_LANGUAGES, D_EXT, 'unknown')} AS suggestion_language,
  {d_case(PR.GRAPH_LANGUAGES, D_EXT, 'unknown')} AS graph_language FROM files"""))
def prj_language(spark, sf_dir):
    e = file_ext(F.col("rel_path"))
    return _files(spark, sf_dir).select(
        "file_id", e.alias("ext"), map_lookup(C.CORE_LANGUAGES, e, "text").alias("core_language"),
        map_lookup(C.ANALYZER_LANGUAGES, e, "unknown").alias("analyzer_language"),
        map_lookup(PR.SUGGESTION_LANGUAGES, e, "unknown").alias("suggestion_language"),
        map_lookup(PR.GRAPH_LANGUAGES, e, "unknown").alias("graph_language"))


@query("prj_file_flags", d_files(f"""
SELECT file_id, {D_EXT} IN ({sql_list(C.CODE_EXTS)}) AS is_code, {D_EXT} IN ({sql_list(C.ANALYZABLE_EXTS)}) AS is_analyzable,
  {D_NAME} IN ({sql_list(C.MAIN_FILES)}) AS is_main, {D_NAME} IN ({sql_list(C.CONFIG_FILES)}) AS is_config FROM files"""))
def prj_file_flags(spark, sf_dir):
    return PR.with_file_attrs(_files(spark, sf_dir)).select("file_id", "is_code", "is_analyzable", "is_main", "is_config")


@query("prj_dirs", d_files(f"""
, f AS (SELECT project_id, {D_DIRS} AS d FROM files WHERE {D_STRUCT} AND len({D_DIRS}) > 0),
e AS (SELECT DISTINCT project_id, array_to_string(list_slice(d, 1, i), '/') AS dir FROM f, LATERAL (SELECT unnest(range(1, len(d) + 1)) AS i) r),
c AS (SELECT project_id, array_to_string(d, '/') AS dir, count(*) AS n FROM f GROUP BY ALL)
SELECT e.project_id, e.dir, CAST(coalesce(c.n, 0) AS BIGINT) AS file_count,
  {d_case(C.DIR_PURPOSES, "lower(string_split(e.dir, '/')[-1])", 'general')} AS purpose
FROM e LEFT JOIN c USING (project_id, dir)"""))
def prj_dirs(spark, sf_dir):
    return PR.directories(_files(spark, sf_dir)).select("project_id", "dir", "file_count", "purpose")


@query("prj_line_count", d_files(f"SELECT file_id, {D_SCANNER} AS scanner_lines, {D_SPLIT} AS split_lines FROM files"))
def prj_line_count(spark, sf_dir):
    scanner, split = PR.line_counts(F.col("content"))
    return _files(spark, sf_dir).select("file_id", scanner.alias("scanner_lines"), split.alias("split_lines"))


@query("prj_file_get", d_files(f"""
SELECT file_id, rel_path, CAST(strlen(content) AS BIGINT) AS size, {d_case(C.CORE_LANGUAGES, D_EXT, 'text')} AS language,
  {D_SCANNER} AS line_count FROM files WHERE rel_path = {sql_str(FILE_GET_PATH)}"""))
def prj_file_get(spark, sf_dir):
    f = PR.with_file_attrs(_files(spark, sf_dir).where(F.col("rel_path") == FILE_GET_PATH))
    scanner, _ = PR.line_counts(F.col("content"))
    return f.select("file_id", "rel_path", "size", "language", scanner.alias("line_count"))


@query("agg_structure", d_files(f"""
SELECT project_id, CAST(count(*) AS BIGINT) AS total_files, CAST(sum(strlen(content)) AS BIGINT) AS total_size,
  CAST(count_if({D_NAME} IN ({sql_list(C.MAIN_FILES)})) AS BIGINT) AS main_files,
  CAST(count_if({D_NAME} IN ({sql_list(C.CONFIG_FILES)})) AS BIGINT) AS config_files,
  min(rel_path) FILTER (WHERE {D_NAME} IN ({sql_list(C.MAIN_FILES)})) AS first_main_file,
  min(rel_path) FILTER (WHERE {D_NAME} IN ({sql_list(C.CONFIG_FILES)})) AS first_config_file
FROM files WHERE {D_STRUCT} GROUP BY project_id"""))
def agg_structure(spark, sf_dir):
    return PR.structure(_files(spark, sf_dir))


@query("agg_structure_lists", d_files(f"""
SELECT s.*, l.list, l.path
FROM (SELECT project_id, CAST(count(*) AS BIGINT) AS total_files, CAST(sum(strlen(content)) AS BIGINT) AS total_size
      FROM files WHERE {D_STRUCT} GROUP BY project_id) s
LEFT JOIN (SELECT project_id, 'main' AS list, rel_path AS path FROM files WHERE {D_STRUCT} AND {D_NAME} IN ({sql_list(C.MAIN_FILES)})
  UNION ALL SELECT project_id, 'config', rel_path FROM files WHERE {D_STRUCT} AND {D_NAME} IN ({sql_list(C.CONFIG_FILES)})) l
ON l.project_id = s.project_id"""))
def agg_structure_lists(spark, sf_dir):
    return PR.structure_lists(_files(spark, sf_dir))


@query("agg_project_type", d_files(f"""
SELECT p.project_id, coalesce(t.t, 'unknown') AS project_type FROM (SELECT DISTINCT project_id FROM files) p
LEFT JOIN (SELECT project_id, arg_min({d_case(dict(C.PROJECT_TYPES), D_NAME, None)}, rel_path) AS t FROM files
           WHERE NOT contains(rel_path, '/') AND {D_NAME} IN ({sql_list([k for k, _ in C.PROJECT_TYPES])}) GROUP BY project_id) t
USING (project_id)"""))
def agg_project_type(spark, sf_dir):
    return PR.project_type(_files(spark, sf_dir))


def d_framework_names() -> str:
    return ", ".join(f"({sql_str(f[0])}, {sql_str(f[1])}, {sql_str(f[2])})" for f in DP.NPM_FRAMEWORKS)


D_LANGMAP = d_case(PR.ext_language_map(), D_EXT, None)
D_TESTS = ("tests", f"""SELECT project_id, bool_or(len(list_filter(string_split(lower(rel_path), '/'),
  lambda s: {' OR '.join(f"contains(s, {sql_str(p)})" for p in PR.TEST_PATTERNS)})) > 0) AS has_tests FROM files GROUP BY project_id""")
D_MAINCASE = "CASE language " + " ".join(
    f"WHEN {sql_str(k)} THEN {D_NAME} IN ({sql_list([m.lower() for m in v])})" for k, v in PR.LANGUAGE_MAIN_FILES.items()) + " END"
D_CFGMAP = d_case({c.lower(): k for k, _, _, cfgs, _ in PR.LANGUAGES for c in cfgs}, D_NAME, None)
D_TOOLS = "CASE language " + " ".join(
    f"WHEN {sql_str(k)} THEN [{sql_list([t.lower() for t in tools])}]" for k, _, _, _, tools in PR.LANGUAGES) + " END"
D_LANGS = ("langs", f"""
WITH le AS (SELECT project_id, language, count(*) AS files, sum({D_SPLIT}) AS lines, count_if({D_MAINCASE}) AS main_files
  FROM (SELECT *, {D_LANGMAP} AS language FROM files WHERE {D_LANGSCOPE}) f WHERE language IS NOT NULL GROUP BY project_id, language),
lc AS (SELECT project_id, language, count(*) AS config_files,
    bool_or(len(list_filter({D_TOOLS}, lambda t: contains(lower(rel_path), t))) > 0) AS has_linting
  FROM (SELECT *, {D_CFGMAP} AS language FROM files WHERE {D_LANGSCOPE}) g WHERE language IS NOT NULL GROUP BY project_id, language)
SELECT coalesce(le.project_id, lc.project_id) AS project_id, coalesce(le.language, lc.language) AS language,
  CAST(coalesce(le.files, 0) AS BIGINT) AS files, CAST(coalesce(le.lines, 0) AS BIGINT) AS lines,
  CAST(coalesce(le.main_files, 0) AS BIGINT) AS main_files, CAST(coalesce(lc.config_files, 0) AS BIGINT) AS config_files,
  coalesce(lc.has_linting, false) AS has_linting
FROM le FULL OUTER JOIN lc ON le.project_id = lc.project_id AND le.language = lc.language""")


@query("agg_languages", duckdb_with(["files", "manifest_json", "framework_manifests"], [D_TESTS, D_LANGS, D_PKG, D_TEXT_FW]) + f"""
, fw AS (SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, language, framework FROM text_fw
  UNION SELECT 'src' || CAST(project_id % 20 AS VARCHAR), f.language, f.framework FROM ({D_NPM}) d
  JOIN (VALUES {d_framework_names()}) AS f(dep, framework, language) ON d.name = f.dep)
SELECT l.*, t.has_tests, coalesce(x.frameworks, '') AS frameworks FROM langs l LEFT JOIN tests t USING (project_id)
LEFT JOIN (SELECT project_id, language, string_agg(framework, ',' ORDER BY framework) AS frameworks FROM fw GROUP BY ALL) x USING (project_id, language)""")
def agg_languages(spark, sf_dir):
    """AGG_LANGUAGES with the names of the frameworks that the project's manifests name (bounded by the catalog)."""
    v = Views(spark, sf_dir)
    named = DP.npm_frameworks(v("manifest_json")).select("project_id", "language", "framework").union(
        DP.manifest_frameworks(v("framework_manifests")).select("project_id", "language", "framework"))
    by_language = named.groupBy(project_key(F.col("project_id")).alias("project_id"), "language").agg(
        F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("frameworks"))
    return PR.detected_languages(_files(spark, sf_dir)).join(by_language, ["project_id", "language"], "left").fillna("", ["frameworks"])


@query("join_has_tests", d_files("SELECT project_id, has_tests FROM tests", [D_TESTS]))
def join_has_tests(spark, sf_dir):
    return PR.has_tests(_files(spark, sf_dir))


@query("join_ext_lang", d_files(f"""
SELECT file_id, {D_LANGMAP} AS language FROM files WHERE {D_LANGSCOPE} AND {D_LANGMAP} IS NOT NULL"""))
def join_ext_lang(spark, sf_dir):
    """JOIN_EXT_LANG: file x language on extension (the fixed extension table is a literal map: no shuffle)."""
    lang = map_lookup(PR.ext_language_map(), file_ext(F.col("rel_path")))
    f = _files(spark, sf_dir).where(PR.language_scope(F.col("rel_path")))
    return f.select("file_id", lang.alias("language")).where(F.col("language").isNotNull())


@query("agg_primary", d_files("""
SELECT project_id, CASE WHEN files > 0 THEN language ELSE 'unknown' END AS primary_language, files AS primary_files FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY files DESC, language) AS r FROM langs) s WHERE r = 1""",
                                 [D_TESTS, D_LANGS]))
def agg_primary(spark, sf_dir):
    return PR.primary_language(PR.detected_languages(_files(spark, sf_dir)))


@query("agg_file_types", d_files(f"""
SELECT project_id, {D_EXT} AS ext, CAST(count(*) AS BIGINT) AS files FROM files WHERE {D_STRUCT} AND {D_EXT} <> '' GROUP BY ALL"""))
def agg_file_types(spark, sf_dir):
    e = file_ext(F.col("rel_path"))
    f = _files(spark, sf_dir).where(PR.structure_scope(F.col("rel_path")) & (e != ""))
    return f.groupBy("project_id", e.alias("ext")).agg(F.count(F.lit(1)).alias("files"))


@query("agg_lang_top", d_files(f"""
SELECT project_id, language, files, CAST(r AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY files DESC, language) AS r FROM (
    SELECT project_id, {d_case(C.CORE_LANGUAGES, D_EXT, 'text')} AS language, CAST(count(*) AS BIGINT) AS files
    FROM files WHERE {D_STRUCT} GROUP BY ALL) a WHERE language <> 'text') b WHERE r <= 8"""))
def agg_lang_top(spark, sf_dir):
    f = PR.with_file_attrs(_files(spark, sf_dir)).where(PR.structure_scope(F.col("rel_path")))
    counts = f.where(F.col("language") != "text").groupBy("project_id", "language").agg(
        F.count(F.lit(1)).alias("files"))
    w = Window.partitionBy("project_id").orderBy(F.col("files").desc(), F.col("language"))
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= 8)


D_TODO_KIND = "CASE " + " ".join(f"WHEN contains(upper(line), {sql_str(m)}) THEN {sql_str(m)}" for m in C.TODO_MARKERS) + " END"
D_TODOS = ("todos", f"""SELECT l.file_id, f.project_id, f.rel_path, l.line_no, k AS todo_type,
  {duck.trim("substr(l.line, strpos(upper(l.line), k))")} AS message
FROM (SELECT *, {D_TODO_KIND} AS k FROM file_lines) l JOIN files f USING (file_id)
WHERE k IS NOT NULL AND {D_EXT.replace('rel_path', 'f.rel_path')} IN ({sql_list(C.CODE_EXTS)})""")


def _todos(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.todos(PR.todo_lines(v("files"), v("file_lines")))


@query("rul_todos", duckdb_with(["files", "file_lines"], [D_TODOS]) + """
SELECT file_id, CAST(line_no AS BIGINT) AS line_no, todo_type, message FROM todos""")
def rul_todos(spark, sf_dir):
    return _todos(spark, sf_dir).select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "todo_type", "message")


def project_key(col):
    """Numeric project ids of the tool and process tables -> the file tree's project name."""
    return F.concat(F.lit("src"), (col % 20).cast("string"))


@query("flt_search", duckdb_with(["files", "file_lines", "tool_output"], [D_TODOS]) + f"""
SELECT 'file' AS kind, 1 AS rank, project_id, rel_path AS path, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS message
FROM files WHERE {D_STRUCT} AND contains(lower(rel_path), {sql_str(SEARCH_TERM)})
UNION ALL
SELECT 'todo', 2, project_id, rel_path, CAST(line_no AS VARCHAR), message FROM todos WHERE contains(lower(message), {sql_str(SEARCH_TERM)})
UNION ALL
SELECT 'error', 3, 'src' || CAST(project_id % 20 AS VARCHAR), file, CAST(line_number AS VARCHAR), message FROM ({D_ACTIVE}) a
WHERE contains(lower(message), {sql_str(SEARCH_TERM)})""")
def flt_search(spark, sf_dir):
    errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    hits = PR.search(_files(spark, sf_dir), _todos(spark, sf_dir), errs, SEARCH_TERM)
    return hits.withColumn("line", F.col("line").cast("string"))


@query("agg_project_stats", duckdb_with(["files", "file_lines", "tool_output"], [D_TODOS]) + f"""
, fs AS (SELECT project_id, CAST(count(*) AS BIGINT) AS total_files, CAST(sum(strlen(content)) AS BIGINT) AS total_size
         FROM files WHERE {D_STRUCT} GROUP BY project_id),
ls AS (SELECT project_id, string_agg(language || ':' || CAST(n AS VARCHAR), ',' ORDER BY language) AS languages FROM (
         SELECT project_id, {d_case(C.CORE_LANGUAGES, D_EXT, 'text')} AS language, count(*) AS n FROM files WHERE {D_STRUCT} GROUP BY ALL) x
       WHERE language <> 'text' GROUP BY project_id),
er AS (SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, count(*) AS errors, count_if(type = 'error') AS e,
         count_if(type = 'warning') AS w FROM ({D_ACTIVE}) a GROUP BY 1),
td AS (SELECT project_id, count(*) AS todos FROM todos GROUP BY project_id)
SELECT fs.project_id, fs.total_files, fs.total_size, coalesce(ls.languages, '') AS languages,
  CAST(coalesce(er.errors, 0) AS BIGINT) AS error_count, CAST(coalesce(td.todos, 0) AS BIGINT) AS todo_count,
  CAST(greatest(0, 100 - 10 * coalesce(er.e, 0) - 3 * coalesce(er.w, 0)) AS BIGINT) AS health_score
FROM fs LEFT JOIN ls USING (project_id) LEFT JOIN er USING (project_id) LEFT JOIN td USING (project_id)""")
def agg_project_stats(spark, sf_dir):
    """AGG_PROJECT_STATS: per project totals, languages (sorted 'lang:count'), error and todo counts, health."""
    files = _files(spark, sf_dir)
    fa = PR.with_file_attrs(files).where(PR.structure_scope(F.col("rel_path")))
    fs = fa.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_files"), F.sum("size").alias("total_size"))
    ls = (fa.where(F.col("language") != "text").groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"))
          .groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_list(
              F.concat_ws(":", "language", F.col("n").cast("string")))), ",").alias("languages")))
    errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    er = errs.groupBy("project_id").agg(F.count(F.lit(1)).alias("errors"))
    hl = health(errs, files.select("project_id").distinct()).select("project_id", F.col("score").alias("health_score"))
    td = _todos(spark, sf_dir).groupBy("project_id").agg(F.count(F.lit(1)).alias("todos"))
    return (fs.join(ls, "project_id", "left").join(er, "project_id", "left").join(td, "project_id", "left")
            .join(hl, "project_id", "left")
            .select("project_id", F.col("total_files").cast("bigint"), F.col("total_size").cast("bigint"),
                    F.coalesce("languages", F.lit("")).alias("languages"),
                    F.coalesce("errors", F.lit(0)).cast("bigint").alias("error_count"),
                    F.coalesce("todos", F.lit(0)).cast("bigint").alias("todo_count"),
                    F.coalesce("health_score", F.lit(100)).cast("bigint").alias("health_score")))
