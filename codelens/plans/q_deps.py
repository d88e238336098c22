"""Dependency queries: manifests, requirement files, package-manager output, frameworks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.operators import deps as DP
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.registry import Views, query, sql_str

DEP_OUT = ["project_id", "name", "version", "type", "source"]

D_PKG = ("pkg", """SELECT project_id, TRY_CAST(json(content) AS STRUCT(name VARCHAR, scripts MAP(VARCHAR, VARCHAR),
  dependencies MAP(VARCHAR, VARCHAR), devDependencies MAP(VARCHAR, VARCHAR))) AS p FROM manifest_json""")
D_NPM = """
SELECT project_id, e.key AS name, e.value AS version, 'direct' AS type, 'package.json' AS source
FROM (SELECT project_id, unnest(map_entries(p.dependencies)) AS e FROM pkg) a
UNION ALL
SELECT project_id, e.key, e.value, 'dev', 'package.json'
FROM (SELECT project_id, unnest(map_entries(p.devDependencies)) AS e FROM pkg) b"""

T = duck.trim("line")
D_GOMOD = f"""
SELECT project_id, line_no, CASE WHEN single THEN f[2] ELSE f[1] END AS name, CASE WHEN single THEN f[3] ELSE f[2] END AS version,
  'direct' AS type, 'go.mod' AS source
FROM (SELECT *, starts_with(t, 'require ') AND t <> 'require (' AND len(f) >= 3 AS single,
        coalesce(st, 0) = 1 AND t <> '' AND NOT starts_with(t, '//') AND t <> ')' AND t <> 'require (' AND len(f) >= 2 AS blk
      FROM (SELECT *, string_split_regex(t, '{duck.WS}+') AS f,
              last_value(CASE WHEN t = 'require (' THEN 1 WHEN t = ')' THEN 0 END IGNORE NULLS)
                OVER (PARTITION BY project_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st
            FROM (SELECT *, {T} AS t FROM gomod_lines) a) b) c
WHERE single OR blk"""

REQ = r"([^=<>!]+)[=<>!]+(.+)"
D_REQ = f"""
SELECT project_id, line_no, CASE WHEN {duck.matches('t', REQ)} THEN {duck.trim(duck.extract('t', REQ, 1))} ELSE t END AS name,
  CASE WHEN {duck.matches('t', REQ)} THEN {duck.trim(duck.extract('t', REQ, 2))} ELSE 'latest' END AS version,
  'direct' AS type, 'requirements.txt' AS source
FROM (SELECT *, {T} AS t FROM requirement_lines) a WHERE t <> '' AND NOT starts_with(t, '#')"""


def d_section(headers: list[str], source: str) -> str:
    hl = ", ".join(sql_str(h) for h in headers)
    return f"""
SELECT project_id, line_no, {duck.trim("split_part(t, '=', 1)")} AS name,
  trim({duck.trim("split_part(t, '=', 2)")}, '"''') AS version, 'direct' AS type, {sql_str(source)} AS source
FROM (SELECT *, last_value(CASE WHEN t IN ({hl}) THEN 1 WHEN starts_with(t, '[') THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY project_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st
      FROM (SELECT *, {T} AS t FROM pyproject_lines) a) b
WHERE st = 1 AND NOT starts_with(t, '[') AND contains(t, '=')"""


D_PYPROJECT = d_section(["[tool.poetry.dependencies]", "[project.dependencies]"], "pyproject.toml")
D_PIPFILE = d_section(["[packages]"], "Pipfile")


def _v(spark, sf_dir, name) -> DataFrame:
    return Views(spark, sf_dir)(name)


@query("dep_npm", duckdb_with(["manifest_json"], [D_PKG]) + D_NPM)
def dep_npm(spark, sf_dir):
    return DP.npm_dependencies(_v(spark, sf_dir, "manifest_json")).select(*DEP_OUT)


@query("dep_ts_types", duckdb_with(["manifest_json"], [D_PKG]) + f"""
SELECT project_id, name, version, CASE WHEN starts_with(name, '@types/') THEN 'types' WHEN name = 'typescript' THEN 'compiler'
  ELSE type END AS type, source FROM ({D_NPM}) d""")
def dep_ts_types(spark, sf_dir):
    return DP.ts_relabel(DP.npm_dependencies(_v(spark, sf_dir, "manifest_json"))).select(*DEP_OUT)


@query("set_merge_maps", duckdb_with(["manifest_json"], [D_PKG]) + f"""
SELECT project_id, name, arg_max(version, CASE WHEN type = 'dev' THEN 1 ELSE 0 END) AS version,
  bool_or(type = 'dev') AS from_dev FROM ({D_NPM}) d GROUP BY project_id, name""")
def set_merge_maps(spark, sf_dir):
    return DP.merged_dependencies(_v(spark, sf_dir, "manifest_json"))


@query("join_missing_types", duckdb_with(["manifest_json"], [D_PKG]) + f"""
SELECT d.project_id, d.name AS dependency, n.tp AS type_package,
  printf('Missing type definitions for ''%s''. Consider installing ''%s''', d.name, n.tp) AS message
FROM ({D_NPM}) d JOIN (VALUES {", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in DP.TYPES_NEEDED.items())}) AS n(dep, tp)
  ON d.name = n.dep AND d.type = 'direct'
WHERE NOT EXISTS (SELECT 1 FROM ({D_NPM}) h WHERE h.project_id = d.project_id AND h.name = n.tp)""")
def join_missing_types(spark, sf_dir):
    return DP.missing_type_packages(_v(spark, sf_dir, "manifest_json"))


@query("dep_gomod", duckdb_with(["gomod_lines"]) + D_GOMOD)
def dep_gomod(spark, sf_dir):
    return DP.gomod_dependencies(_v(spark, sf_dir, "gomod_lines")).select("project_id", "line_no", "name", "version", "type", "source")


@query("dep_requirements", duckdb_with(["requirement_lines"]) + D_REQ)
def dep_requirements(spark, sf_dir):
    return (DP.requirements_dependencies(_v(spark, sf_dir, "requirement_lines"))
            .select("project_id", "line_no", "name", "version", "type", "source"))


@query("dep_pyproject", duckdb_with(["pyproject_lines"]) + D_PYPROJECT)
def dep_pyproject(spark, sf_dir):
    return (DP.section_dependencies(_v(spark, sf_dir, "pyproject_lines"),
                                    ["[tool.poetry.dependencies]", "[project.dependencies]"], "pyproject.toml")
            .select("project_id", "line_no", "name", "version", "type", "source"))


@query("dep_pipfile", duckdb_with(["pyproject_lines"]) + D_PIPFILE)
def dep_pipfile(spark, sf_dir):
    return (DP.section_dependencies(_v(spark, sf_dir, "pyproject_lines"), ["[packages]"], "Pipfile")
            .select("project_id", "line_no", "name", "version", "type", "source"))


@query("dep_pm_output", duckdb_with(["pm_output"]) + f"""
SELECT seq, pm, CASE pm WHEN 'npm' THEN {duck.trim("split_part(t, '@', 1)")} WHEN 'pip' THEN {duck.trim("split_part(t, '==', 1)")}
    ELSE f[1] END AS name,
  CASE pm WHEN 'npm' THEN {duck.trim("split_part(t, '@', 2)")} WHEN 'pip' THEN {duck.trim("split_part(t, '==', 2)")}
    ELSE f[2] END AS version,
  'direct' AS type, CASE WHEN pm = 'go' THEN 'go.mod' ELSE pm END AS source
FROM (SELECT *, string_split_regex(t, '{duck.WS}+') AS f FROM (SELECT *, {T} AS t FROM pm_output) a) b
WHERE t <> '' AND ((pm = 'npm' AND contains(t, '@') AND len(string_split(t, '@')) >= 2)
   OR (pm = 'pip' AND contains(t, '==') AND len(string_split(t, '==')) = 2)
   OR (pm = 'go' AND NOT starts_with(t, 'go.mod') AND len(f) >= 2))""")
def dep_pm_output(spark, sf_dir):
    return (DP.package_manager_output(_v(spark, sf_dir, "pm_output"))
            .select("seq", "pm", "name", "version", "type", "source"))


def all_dependencies(spark, sf_dir) -> DataFrame:
    """DEP_ALL: every manifest's dependencies, one frame."""
    npm = DP.npm_dependencies(_v(spark, sf_dir, "manifest_json")).select(*DEP_OUT)
    parts = [npm,
             DP.gomod_dependencies(_v(spark, sf_dir, "gomod_lines")).select(*DEP_OUT),
             DP.requirements_dependencies(_v(spark, sf_dir, "requirement_lines")).select(*DEP_OUT),
             DP.section_dependencies(_v(spark, sf_dir, "pyproject_lines"),
                                     ["[tool.poetry.dependencies]", "[project.dependencies]"],
                                     "pyproject.toml").select(*DEP_OUT),
             DP.section_dependencies(_v(spark, sf_dir, "pyproject_lines"), ["[packages]"],
                                     "Pipfile").select(*DEP_OUT)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


D_ALL = f"""
SELECT project_id, name, version, type, source FROM ({D_NPM}) a
UNION ALL SELECT project_id, name, version, type, source FROM ({D_GOMOD}) b
UNION ALL SELECT project_id, name, version, type, source FROM ({D_REQ}) c
UNION ALL SELECT project_id, name, version, type, source FROM ({D_PYPROJECT}) d
UNION ALL SELECT project_id, name, version, type, source FROM ({D_PIPFILE}) e"""
ALL_VIEWS = ["manifest_json", "gomod_lines", "requirement_lines", "pyproject_lines"]


@query("dep_all", duckdb_with(ALL_VIEWS, [D_PKG]) + f"""
SELECT CAST(project_id AS VARCHAR) AS project, name, version, type, source FROM ({D_ALL}) x""")
def dep_all(spark, sf_dir):
    d = all_dependencies(spark, sf_dir)
    return d.select(F.col("project_id").cast("string").alias("project"), *DEP_OUT[1:])


@query("agg_deps_by_lang", duckdb_with(ALL_VIEWS, [D_PKG]) + f"""
SELECT CASE source {" ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in DP.SOURCE_LANGUAGE.items())}
  ELSE 'unknown' END AS language, CAST(count(*) AS BIGINT) AS dependencies,
  CAST(count_if(type = 'direct') AS BIGINT) AS direct, CAST(count_if(type = 'dev') AS BIGINT) AS dev
FROM ({D_ALL}) x GROUP BY 1""")
def agg_deps_by_lang(spark, sf_dir):
    d = all_dependencies(spark, sf_dir).withColumn("language", DP.dependency_language(F.col("source")))
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("dependencies"),
                                     F.count_if(F.col("type") == "direct").cast("bigint").alias("direct"),
                                     F.count_if(F.col("type") == "dev").cast("bigint").alias("dev"))


def _d_fw_map(fws) -> str:
    return ", ".join(f"({sql_str(f[0])}, {sql_str(f[1])}, {sql_str(f[2])}, {f[3]}, {sql_str(f[4])}, "
                     f"{sql_str(f[5])}, {sql_str(f[6])})" for f in fws)


# frameworks in text manifests, written out for the oracle
D_TEXT_FW = ("text_fw", """SELECT DISTINCT m.project_id, f.framework, f.language, CAST(f.port AS BIGINT) AS port, f.dev_command, m.config_file
FROM framework_manifests m JOIN (VALUES
 ('requirements.txt', 'django', 'Django', 'python', 8000, 'python manage.py runserver'), ('requirements.txt', 'flask', 'Flask', 'python', 5000, 'flask run'),
 ('requirements.txt', 'fastapi', 'FastAPI', 'python', 8000, 'uvicorn main:app --reload'), ('go.mod', 'gin', 'Gin', 'go', 8080, 'go run main.go'),
 ('go.mod', 'echo', 'Echo', 'go', 8080, 'go run main.go'), ('go.mod', 'fiber', 'Fiber', 'go', 3000, 'go run main.go'),
 ('pom.xml', 'spring-boot', 'Spring Boot', 'java', 8080, 'mvn spring-boot:run'), ('pom.xml', 'quarkus', 'Quarkus', 'java', 8080, 'mvn quarkus:dev'),
 ('composer.json', 'laravel', 'Laravel', 'php', 8000, 'php artisan serve'), ('composer.json', 'symfony', 'Symfony', 'php', 8000, 'symfony server:start'),
 ('Gemfile', 'rails', 'Ruby on Rails', 'ruby', 3000, 'rails server'), ('Gemfile', 'sinatra', 'Sinatra', 'ruby', 4567, 'ruby app.rb'))
 AS f(config_file, dep, framework, language, port, dev_command) ON m.config_file = f.config_file AND contains(lower(m.line), f.dep)""")


@query("dep_frameworks", duckdb_with(["manifest_json", "gomod_lines", "pyproject_lines", "requirement_lines", "framework_manifests"], [D_PKG, D_TEXT_FW]) + f"""
SELECT project_id, framework, language, port, dev_command, CAST(NULL AS VARCHAR) AS version, config_file FROM text_fw
UNION ALL
SELECT m.project_id, f.framework, f.language, CAST(f.port AS BIGINT) AS port, f.dev_command, m.version,
  'package.json' AS config_file
FROM (SELECT project_id, name, arg_max(version, CASE WHEN type = 'dev' THEN 1 ELSE 0 END) AS version FROM ({D_NPM}) d
      GROUP BY project_id, name) m
JOIN (VALUES {_d_fw_map(DP.NPM_FRAMEWORKS)}) AS f(dep, framework, language, port, dev_command, build_command, test_command)
  ON m.name = f.dep
UNION ALL
SELECT DISTINCT m.project_id, f.framework, f.language, CAST(f.port AS BIGINT), f.dev_command, CAST(NULL AS VARCHAR), 'go.mod'
FROM gomod_lines m JOIN (VALUES {_d_fw_map(DP.GO_FRAMEWORKS)}) AS f(dep, framework, language, port, dev_command, build_command, test_command)
  ON contains(lower(m.line), f.dep)
UNION ALL
SELECT DISTINCT m.project_id, f.framework, f.language, CAST(f.port AS BIGINT), f.dev_command, CAST(NULL AS VARCHAR), 'requirements.txt'
FROM requirement_lines m JOIN (VALUES {_d_fw_map(DP.PY_FRAMEWORKS)}) AS f(dep, framework, language, port, dev_command, build_command, test_command)
  ON contains(lower(m.line), f.dep)""")
def dep_frameworks(spark, sf_dir):
    npm = (DP.npm_frameworks(_v(spark, sf_dir, "manifest_json"))
           .select("project_id", "framework", "language", "port", "dev_command", "version",
                   F.lit("package.json").alias("config_file")))
    nov = F.lit(None).cast("string").alias("version")
    go = DP.substring_frameworks(_v(spark, sf_dir, "gomod_lines"), DP.GO_FRAMEWORKS, "go.mod")
    py = DP.substring_frameworks(_v(spark, sf_dir, "requirement_lines"), DP.PY_FRAMEWORKS, "requirements.txt")
    cols = ["framework", "language", "port", "dev_command"]
    text = DP.manifest_frameworks(_v(spark, sf_dir, "framework_manifests"))
    npm = npm.unionByName(text.select("project_id", *cols, nov, "config_file"))
    return (npm.unionByName(go.select("project_id", *cols, nov, "config_file"))
            .unionByName(py.select("project_id", *cols, nov, "config_file")))
