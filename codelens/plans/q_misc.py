"""Remaining catalog queries: imports, relative time, bands, manifests, package managers, config joins,
top lists, unions, plug-in registry, snapshot creation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.text import basename, file_ext, trim_ws
from codelens.operators import deps as DP
from codelens.operators import diagnostics as D
from codelens.operators import process as P
from codelens.operators import project as PR
from codelens.operators.rules import attach, todos
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.q_deps import D_ALL, D_PKG, all_dependencies
from codelens.plans.q_diagnostics import FLAKE8, MYPY, TOOL_LANG_CASE
from codelens.plans.q_overview import D_STATE_CTES, STATE_VIEWS, project_state
from codelens.plans.q_project import D_DIRS, D_EXT, D_PLUGSCOPE, D_TODOS, d_case
from codelens.plans.q_streams import D_CHANGES
from codelens.plans.registry import Views, query, sql_list, sql_str

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# ------------------------------------------------------------ ERR_PY_IMPORT

@query("err_py_import", duckdb_with(["files", "file_lines"]) + f"""
SELECT l.file_id, string_split(f.rel_path, '/')[-1] AS file, CAST(l.line_no AS BIGINT) AS line_no, 'import' AS type,
  'Potentially problematic relative import: ' || t AS message
FROM (SELECT *, {duck.trim('line')} AS t FROM file_lines) l JOIN files f USING (file_id)
WHERE {D_EXT.replace('rel_path', 'f.rel_path')} IN ('.py', '.pyw', '.pyx', '.pyi') AND {D_PLUGSCOPE.replace('rel_path', 'f.rel_path')}
  AND NOT contains(f.rel_path, 'venv') AND NOT contains(f.rel_path, '__pycache__')
  AND (starts_with(t, 'import ') OR starts_with(t, 'from ')) AND contains(t, '..') AND NOT contains(t, '...')""")
def err_py_import(spark, sf_dir):
    """ERR_PY_IMPORT: relative imports with '..' but not '...' in Python files of the plug-in scope."""
    v = Views(spark, sf_dir)
    p = F.col("rel_path")
    py = v("files").where(file_ext(p).isin(".py", ".pyw", ".pyx", ".pyi") & PR.plugin_scope(p)
                          & ~p.contains("venv") & ~p.contains("__pycache__"))
    lines = attach(v("file_lines"), py, cols=("rel_path",)).withColumn("t", trim_ws(F.col("line")))
    t = F.col("t")
    hit = (t.startswith("import ") | t.startswith("from ")) & t.contains("..") & ~t.contains("...")
    return lines.where(hit).select("file_id", basename(p).alias("file"), F.col("line_no").cast("bigint").alias("line_no"),
                                   F.lit("import").alias("type"),
                                   F.concat(F.lit("Potentially problematic relative import: "), t).alias("message"))


# ------------------------------------------------------------ PRJ_RELATIVE_TIME, PRJ_HEALTH_BAND, PRJ_DEP_LANGUAGE

@query("prj_relative_time", duckdb_with(["snapshots"]) + """
SELECT snapshot_id, CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago' WHEN h < 24 THEN CAST(h AS VARCHAR) || 'h ago'
  WHEN d < 7 THEN CAST(d AS VARCHAR) || 'd ago' ELSE strftime(created_at, '%Y-%m-%d') END AS age
FROM (SELECT snapshot_id, created_at, floor(epoch_ms(a) - epoch_ms(created_at)) AS ms,
        CAST(floor((epoch_ms(a) - epoch_ms(created_at)) / 60000) AS BIGINT) AS m,
        CAST(floor((epoch_ms(a) - epoch_ms(created_at)) / 3600000) AS BIGINT) AS h,
        CAST(floor((epoch_ms(a) - epoch_ms(created_at)) / 86400000) AS BIGINT) AS d
      FROM snapshots, (SELECT max(created_at) AS a FROM snapshots) x) s""")
def prj_relative_time(spark, sf_dir):
    """PRJ_RELATIVE_TIME: age against a fixed ``as_of`` (the newest snapshot): 5m / 3h / 2d ago, else the date."""
    s = Views(spark, sf_dir)("snapshots")
    as_of = s.select(F.max("created_at")).scalar()
    ms = F.timestamp_diff("MILLISECOND", F.col("created_at"), as_of)
    m, h, d = F.floor(ms / 60000), F.floor(ms / 3600000), F.floor(ms / 86400000)
    age = (F.when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(h < 24, F.concat(h.cast("string"), F.lit("h ago")))
           .when(d < 7, F.concat(d.cast("string"), F.lit("d ago"))).otherwise(F.date_format("created_at", "yyyy-MM-dd")))
    return s.select("snapshot_id", age.alias("age"))


@query("prj_health_band", duckdb_with(STATE_VIEWS, D_STATE_CTES) + """
SELECT project_id, health_score, CASE WHEN health_score >= 80 THEN 'healthy' WHEN health_score >= 50 THEN 'warning'
  ELSE 'error' END AS band FROM st""")
def prj_health_band(spark, sf_dir):
    """PRJ_HEALTH_BAND: health per project and its band, reading only what health needs."""
    from codelens.plans.q_diagnostics import active_errors
    from codelens.plans.q_project import project_key
    files = Views(spark, sf_dir)("files")
    projects = files.where(PR.structure_scope(F.col("rel_path"))).select("project_id").distinct()
    errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    h = D.health(errs, projects)
    return h.select("project_id", F.col("score").alias("health_score"), D.health_band(F.col("score")).alias("band"))


@query("prj_dep_language", duckdb_with(["manifest_json", "gomod_lines", "requirement_lines", "pyproject_lines"], [D_PKG]) + f"""
SELECT source, {d_case(DP.SOURCE_LANGUAGE, 'source', 'unknown')} AS language, CAST(count(*) AS BIGINT) AS dependencies
FROM ({D_ALL}) x GROUP BY source""")
def prj_dep_language(spark, sf_dir):
    d = all_dependencies(spark, sf_dir)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("dependencies")).withColumn(
        "language", DP.dependency_language(F.col("source")))


# ------------------------------------------------------------ SRC_MANIFEST, DEP_PKG_MANAGER

@query("src_manifest", duckdb_with(["manifest_json"], [D_PKG]) + """
SELECT project_id, p.name AS name, p IS NOT NULL AS parsed, CAST(coalesce(cardinality(p.scripts), 0) AS BIGINT) AS scripts,
  CAST(coalesce(cardinality(p.dependencies), 0) AS BIGINT) AS dependencies,
  CAST(coalesce(cardinality(p.devDependencies), 0) AS BIGINT) AS dev_dependencies FROM pkg""")
def src_manifest(spark, sf_dir):
    """SRC_MANIFEST: package.json text to typed maps (PERMISSIVE: unparsable text gives NULL)."""
    p = DP.parse_manifest(Views(spark, sf_dir)("manifest_json"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return p.select("project_id", F.col("pkg.name").alias("name"), F.col("pkg").isNotNull().alias("parsed"),
                    F.when(F.col("pkg.scripts").isNull(), 0).otherwise(F.size("pkg.scripts")).cast("bigint").alias("scripts"),
                    F.when(F.col("pkg.dependencies").isNull(), 0).otherwise(size("pkg.dependencies")).alias("dependencies"),
                    F.when(F.col("pkg.devDependencies").isNull(), 0).otherwise(size("pkg.devDependencies")).alias("dev_dependencies"))


@query("dep_pkg_manager", duckdb_with(["files", "pyproject_lines"]) + """
SELECT p.project_id, 'javascript' AS language, coalesce(l.m, 'npm') AS package_manager FROM (SELECT DISTINCT project_id FROM files) p
LEFT JOIN (SELECT project_id, arg_min(CASE n WHEN 'yarn.lock' THEN 'yarn' WHEN 'pnpm-lock.yaml' THEN 'pnpm' ELSE 'bun' END,
    CASE n WHEN 'yarn.lock' THEN 1 WHEN 'pnpm-lock.yaml' THEN 2 ELSE 3 END) AS m
  FROM (SELECT project_id, lower(rel_path) AS n FROM files WHERE NOT contains(rel_path, '/')) f
  WHERE n IN ('yarn.lock', 'pnpm-lock.yaml', 'bun.lockb') GROUP BY project_id) l USING (project_id)
UNION ALL
SELECT 'pyproject.toml', 'python', CASE WHEN bool_or(contains(line, '[tool.poetry]')) THEN 'poetry' ELSE 'pip' END FROM pyproject_lines""")
def dep_pkg_manager(spark, sf_dir):
    """DEP_PKG_MANAGER: yarn > pnpm > bun by a root lock file, else npm; poetry when pyproject has [tool.poetry]."""
    v = Views(spark, sf_dir)
    files = v("files")
    locks = files.where(~F.col("rel_path").contains("/")).select("project_id", F.lower("rel_path").alias("name"))
    js = (files.select("project_id").distinct().join(DP.package_manager(locks), "project_id", "left")
          .select("project_id", F.lit("javascript").alias("language"),
                  F.coalesce("package_manager", F.lit("npm")).alias("package_manager")))
    py = (v("pyproject_lines").agg(F.max(F.col("line").contains("[tool.poetry]")).alias("poetry"))
          .select(F.lit("pyproject.toml").alias("project_id"), F.lit("python").alias("language"),
                  F.when(F.col("poetry"), "poetry").otherwise("pip").alias("package_manager")))
    return js.unionByName(py)


# ------------------------------------------------------------ JOIN_CONFIG_LANG, JOIN_LINT_SETUP

CFG_PAIRS = [(c.lower(), k) for k, _, _, cfgs, _ in PR.LANGUAGES for c in cfgs]
LINT_PAIRS = [(t.lower(), k) for k, _, _, _, tools in PR.LANGUAGES for t in tools]


@query("join_config_lang", duckdb_with(["files"]) + f"""
SELECT f.file_id, f.rel_path, c.language FROM files f JOIN (VALUES {", ".join(f"({sql_str(a)}, {sql_str(b)})" for a, b in CFG_PAIRS)})
  AS c(name, language) ON lower(string_split(f.rel_path, '/')[-1]) = c.name""")
def join_config_lang(spark, sf_dir):
    """JOIN_CONFIG_LANG: file x language on the lower-cased config base name (fixed, broadcast table)."""
    dim = F.broadcast(spark.createDataFrame(CFG_PAIRS, "name string, language string"))
    f = Views(spark, sf_dir)("files").withColumn("name", F.lower(basename(F.col("rel_path"))))
    return f.join(dim, "name").select("file_id", "rel_path", "language")


@query("join_lint_setup", duckdb_with(["files"]) + f"""
SELECT DISTINCT f.project_id, c.language FROM files f JOIN (VALUES {", ".join(f"({sql_str(a)}, {sql_str(b)})" for a, b in CFG_PAIRS)})
  AS c(name, language) ON lower(string_split(f.rel_path, '/')[-1]) = c.name
JOIN (VALUES {", ".join(f"({sql_str(a)}, {sql_str(b)})" for a, b in LINT_PAIRS)}) AS t(tool, language)
  ON t.language = c.language AND contains(lower(f.rel_path), t.tool)""")
def join_lint_setup(spark, sf_dir):
    """JOIN_LINT_SETUP: a language has linting when a lint tool name is inside one of its config paths
    (theta join against a fixed table of at most a few dozen tools: broadcast nested loop, bounded)."""
    cfg = join_config_lang(spark, sf_dir).join(Views(spark, sf_dir)("files").select("file_id", "project_id"), "file_id")
    tools = F.broadcast(spark.createDataFrame(LINT_PAIRS, "tool string, language string"))
    return (cfg.join(tools, (cfg["language"] == tools["language"]) & F.lower(cfg["rel_path"]).contains(tools["tool"]))
            .select("project_id", cfg["language"]).distinct())


# ------------------------------------------------------------ SRT_TOP_LISTS, SET_UNION

@query("srt_top_lists", duckdb_with(["files", "file_lines", "ps_lines", "file_observations"], [D_TODOS, D_CHANGES]) + """
SELECT 'todos' AS list, project_id, CAST(r AS BIGINT) AS rank, rel_path || ':' || CAST(line_no AS VARCHAR) AS item FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rel_path, line_no) AS r FROM todos) t WHERE r <= 10
UNION ALL
SELECT 'processes', project_id, CAST(r AS BIGINT), line FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS r FROM ps_lines) p WHERE r <= 8
UNION ALL
SELECT 'changes', split_part(path, '/', 1), CAST(r AS BIGINT), path || ' ' || change_type FROM (
  SELECT *, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY seq DESC) AS r
  FROM changes WHERE change_type IS NOT NULL) c WHERE r <= 10""")
def srt_top_lists(spark, sf_dir):
    """SRT_TOP_LISTS: per project the first 10 todos, the first 8 process lines, the newest 10 changes
    (the cut is the feature; each is a partial top-k before any shuffle)."""
    v = Views(spark, sf_dir)
    t = todos(PR.todo_lines(v("files"), v("file_lines")))
    tt = P.top_k(t, ["project_id"], [F.col("rel_path"), F.col("line_no")], 10).select(
        F.lit("todos").alias("list"), "project_id", "rank",
        F.concat(F.col("rel_path"), F.lit(":"), F.col("line_no").cast("string")).alias("item"))
    pp = P.top_k(v("ps_lines"), ["project_id"], [F.col("seq")], 8).select(
        F.lit("processes").alias("list"), "project_id", "rank", F.col("line").alias("item"))
    changes = P.file_changes(v("file_observations")).withColumn("project_id", P.change_project(F.col("path")))
    ch = P.top_k(changes, ["project_id"], [F.col("seq").desc()], 10).select(
        F.lit("changes").alias("list"), "project_id", "rank",
        F.concat_ws(" ", "path", "change_type").alias("item"))
    return tt.unionByName(pp).unionByName(ch)


@query("set_union", duckdb_with(["tool_output"]) + f"""
SELECT seq, 'flake8' AS source, 'lint' AS type FROM tool_output WHERE tool = 'flake8' AND {duck.matches('line', FLAKE8)}
UNION ALL SELECT seq, 'mypy', 'type' FROM tool_output WHERE tool = 'mypy' AND {duck.matches('line', MYPY)}
UNION ALL SELECT seq, 'python', {duck.first_match_fields('python')['type']} FROM tool_output
  WHERE {TOOL_LANG_CASE} = 'python' AND {duck.first_match_fields('python')['hit']}""")
def set_union(spark, sf_dir):
    """SET_UNION: the Python analyzers' results appended (duplicates kept)."""
    t = Views(spark, sf_dir)("tool_output")
    f8 = D.flake8_errors(t.where(F.col("tool") == "flake8")).select("seq", "source", "type")
    mp = D.mypy_errors(t.where(F.col("tool") == "mypy")).select("seq", "source", "type")
    py = t.where(F.col("tool").isin([k for k, v in C.TOOL_LANGUAGE.items() if v == "python"]))
    ps = D.pattern_scan(py, "python").select("seq", "source", "type")
    return f8.unionByName(mp).unionByName(ps)


# ------------------------------------------------------------ UDX_PLUGIN

PLUGINS = [(k, len(C.LANGUAGE_PATTERNS.get(k, [])), k in ("javascript", "typescript", "python", "go"),
            k in ("javascript", "python", "go")) for k, _, _, _, _ in PR.LANGUAGES]


@query("udx_plugin", duckdb_with(["files"], [("langs0", f"""SELECT project_id, {d_case(PR.ext_language_map(), D_EXT, None)} AS language
  FROM files WHERE len(list_filter({D_DIRS}, lambda s: (starts_with(s, '.') AND s <> '.env')
  OR s IN ({sql_list(PR.LANGUAGE_SKIP_DIRS)}))) = 0""")]) + f"""
SELECT DISTINCT l.project_id, l.language AS plugin, p.patterns, p.has_dependencies, p.has_tests
FROM langs0 l JOIN (VALUES {", ".join(f"({sql_str(a)}, {b}, {str(c).lower()}, {str(d).lower()})" for a, b, c, d in PLUGINS)})
  AS p(language, patterns, has_dependencies, has_tests) USING (language)""")
def udx_plugin(spark, sf_dir):
    """UDX_PLUGIN: the plug-ins each project activates (detected by extension) and what each one provides.

    The registry is a fixed table of rows (language, pattern count, capabilities); a plug-in is just
    rows in the catalogs plus DataFrame functions, so activating one is an equi-join."""
    reg = F.broadcast(spark.createDataFrame(PLUGINS, "language string, patterns int, has_dependencies boolean, has_tests boolean"))
    langs = (Views(spark, sf_dir)("files").where(PR.language_scope(F.col("rel_path")))
             .select("project_id", F.try_element_at(F.create_map(*[F.lit(x) for kv in PR.ext_language_map().items() for x in kv]),
                                                    file_ext(F.col("rel_path"))).alias("language")))
    return (langs.join(reg, "language").select("project_id", F.col("language").alias("plugin"), "patterns",
                                               "has_dependencies", "has_tests").distinct())


# ------------------------------------------------------------ SNP_CREATE

@query("snp_create", duckdb_with(STATE_VIEWS, D_STATE_CTES) + """
SELECT project_id, 'Snapshot of ' || project_id AS name, 'discovery' AS phase, 'initial' AS tags, CAST(1 AS BIGINT) AS version,
  health_score, total_files, error_count, CAST(NULL AS VARCHAR) AS parent_id FROM st""")
def snp_create(spark, sf_dir):
    """SNP_CREATE: one snapshot row per project from its state, with the defaults (discovery, initial, version 1)."""
    s = project_state(spark, sf_dir)
    return s.select("project_id", F.concat(F.lit("Snapshot of "), F.col("project_id")).alias("name"),
                    F.lit("discovery").alias("phase"), F.lit("initial").alias("tags"), F.lit(1).cast("bigint").alias("version"),
                    "health_score", "total_files", "error_count", F.lit(None).cast("string").alias("parent_id"))
