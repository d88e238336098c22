"""Topology queries: services, ports, project graph nodes and links, graph metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions.text import file_ext, map_lookup
from codelens.operators import deps as DP
from codelens.operators import diagnostics as D
from codelens.operators import project as PR
from codelens.operators import topology as T
from codelens.plans.fixtures import duckdb_with
from codelens.plans.q_deps import D_NPM, D_PKG, D_TEXT_FW
from codelens.plans.q_diagnostics import D_ACTIVE, active_errors
from codelens.plans.q_project import D_LANGS, D_STRUCT, D_TESTS, d_case, d_framework_names, project_key
from codelens.plans.registry import Views, query, sql_str

VIEWS = ["files", "manifest_json", "listening_ports", "tool_output"]


def _fw_case(what: str) -> str:
    parts = []
    for dep, name, port in T.SERVICE_FRAMEWORKS:
        val = sql_str(name) if what == "fw" else str(port)
        parts.append(f"WHEN map_contains(p.dependencies, {sql_str(dep)}) THEN {val}")
    default = "'unknown'" if what == "fw" else "3000"
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


D_SVC0 = ("svc0", f"""SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, 'js-' || p.name AS service_id, p.name AS name,
  'javascript' AS language, {_fw_case('fw')} AS framework, CAST({_fw_case('port')} AS BIGINT) AS port,
  CASE WHEN map_contains(p.scripts, 'start') THEN printf('npm run start (%s)', p.scripts['start'])
       WHEN map_contains(p.scripts, 'dev') THEN printf('npm run dev (%s)', p.scripts['dev']) END AS start_command
FROM pkg WHERE p IS NOT NULL""")
D_SVC = ("svc", """SELECT s.*, CASE WHEN s.port IN (SELECT port FROM listening_ports) THEN 'running' ELSE 'stopped' END AS status FROM svc0 s""")
D_ERRF = ("errf", f"""SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, coalesce(nullif(file, ''), 'unknown') AS file,
  count(*) AS errors FROM ({D_ACTIVE}) a GROUP BY ALL""")
D_DEPG = ("depg", """SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, 'javascript' AS language, count(*) AS dependencies
FROM (SELECT project_id, unnest(map_keys(p.dependencies)) FROM pkg UNION ALL SELECT project_id, unnest(map_keys(p.devDependencies)) FROM pkg) d
GROUP BY ALL""")
COLOR_CASE = d_case(T.LANGUAGE_COLORS, "lower(language)", T.DEFAULT_COLOR)
D_NODES = ("nodes", f"""
SELECT DISTINCT project_id, 'project' AS node_id, 'project' AS node_type, 'Project' AS name, CAST(40 AS BIGINT) AS size, '{T.DEFAULT_COLOR}' AS color FROM files
UNION ALL SELECT project_id, 'lang-' || language, 'language', language, CAST(least(35, 20 + 2 * files) AS BIGINT), {COLOR_CASE} FROM langs
UNION ALL SELECT project_id, 'service-' || service_id, 'service', name, CAST(25 AS BIGINT),
  CASE status WHEN 'running' THEN '{T.STATUS_COLORS["running"]}' WHEN 'error' THEN '{T.STATUS_COLORS["error"]}' ELSE '{T.WARNING_COLOR}' END FROM svc
UNION ALL SELECT project_id, 'error-' || file, 'error', printf('%s (%d errors)', file, errors), CAST(least(30, 15 + 2 * errors) AS BIGINT), '#f44336' FROM errf
UNION ALL SELECT project_id, 'deps-' || language, 'dependencies', printf('%s Dependencies (%d)', language, dependencies),
  CAST(least(28, 18 + 2 * dependencies) AS BIGINT), '#4caf50' FROM depg WHERE dependencies > 5""")
GRAPH_LANG = d_case(PR.GRAPH_LANGUAGES, r"lower(regexp_extract(file, '(\.[^./]*)$', 1))", "unknown")
D_LINKS = ("links", f"""
SELECT project_id, 'project' AS source, 'lang-' || language AS target, 'hierarchy' AS link_type, CAST(1.0 AS DOUBLE) AS strength FROM langs
UNION ALL SELECT project_id, 'lang-' || language, 'service-' || service_id, 'association', 0.8 FROM svc
UNION ALL SELECT project_id, 'lang-' || {GRAPH_LANG}, 'error-' || file, 'error', 0.6 FROM errf
UNION ALL SELECT project_id, 'lang-' || language, 'deps-' || language, 'dependency', 0.7 FROM depg WHERE dependencies > 5""")
GRAPH_CTES = [D_PKG, D_TESTS, D_LANGS, D_SVC0, D_SVC, D_ERRF, D_DEPG, D_NODES, D_LINKS]


def d_graph(body: str) -> str:
    return duckdb_with(VIEWS, GRAPH_CTES) + body


class Graph:
    """The per-project inputs of the graph, built once per query."""

    def __init__(self, spark, sf_dir):
        v = Views(spark, sf_dir)
        files = v("files")
        self.v = v
        self.files = files
        self.languages = PR.detected_languages(files)
        self.services = T.package_services(v("manifest_json"), v("listening_ports"), project_key(F.col("project_id")))
        self.errors = errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
        self.error_files = (errs.groupBy("project_id", F.coalesce(F.nullif(F.col("file"), F.lit("")), F.lit("unknown"))
                                         .alias("file")).agg(F.count(F.lit(1)).alias("errors")))
        deps = DP.npm_dependencies(v("manifest_json")).withColumn("project_id", project_key(F.col("project_id")))
        self.deps = deps.withColumn("language", DP.dependency_language(F.col("source")))
        self.dep_groups = (self.deps
                           .groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("dependencies")))

    def nodes(self):
        projects = self.files.select("project_id").distinct()
        return T.graph_nodes(projects, self.languages, self.services, self.error_files, self.dep_groups)

    def metadata(self):
        size = PR.structure(self.files).select("project_id", "total_files", "total_size")
        health = D.health(self.errors, self.files.select("project_id").distinct()).select("project_id", F.col("score").alias("health_score"))
        named = (DP.npm_frameworks(self.v("manifest_json")).select("project_id", "language", "framework")
                 .union(DP.manifest_frameworks(self.v("framework_manifests")).select("project_id", "language", "framework"))
                 .groupBy(project_key(F.col("project_id")).alias("project_id"), "language")  # at most the catalog's names
                 .agg(F.sort_array(F.collect_set("framework")).alias("frameworks")))
        errors = self.errors.select("project_id", F.coalesce(F.nullif(F.col("file"), F.lit("")), F.lit("unknown")).alias("file"), "seq", "message")
        return T.graph_node_metadata(health.join(size, "project_id", "left"), self.languages.join(named, ["project_id", "language"], "left"), self.services,
                                     errors, self.deps.select("project_id", "language", "name"), {k: exts for k, _, exts, _, _ in PR.LANGUAGES})

    def links(self):
        lang = map_lookup(PR.GRAPH_LANGUAGES, file_ext(F.col("file")), "unknown")
        return T.graph_links(self.languages, self.services, self.error_files, self.dep_groups, lang)


@query("join_services", d_graph("SELECT project_id, service_id, name, language, framework, port, start_command, status FROM svc"))
def join_services(spark, sf_dir):
    return Graph(spark, sf_dir).services


@query("join_ports", d_graph("""
SELECT l.project_id, l.language, CAST(p.port AS BIGINT) AS port, l.language || '-' || CAST(p.port AS VARCHAR) AS service_id
FROM langs l JOIN (VALUES """ + ", ".join(f"({sql_str(k)}, {p})" for k, v in T.DEFAULT_PORTS.items() for p in v) + """) AS d(language, port)
  USING (language) JOIN (SELECT DISTINCT port FROM listening_ports) p ON p.port = d.port"""))
def join_ports(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return T.generic_port_services(g.languages, Views(spark, sf_dir)("listening_ports"))


@query("join_ts_services", d_graph("""
SELECT s.project_id, s.service_id, CASE WHEN t.project_id IS NOT NULL THEN 'typescript' ELSE s.language END AS language
FROM svc s LEFT JOIN (SELECT DISTINCT project_id FROM langs WHERE language = 'typescript') t USING (project_id)"""))
def join_ts_services(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return T.ts_relabel_services(g.services, g.languages).select("project_id", "service_id", "language")


@query("join_service_lang", d_graph("""
SELECT s.project_id, 'implements' AS type, 'language-' || s.language AS from_id, 'service-' || s.service_id AS to_id,
  printf('%s service using %s framework', s.name, s.framework) AS description
FROM svc s JOIN langs l ON l.project_id = s.project_id AND l.language = s.language"""))
def join_service_lang(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return T.service_language_links(g.services, g.languages)


@query("prj_node_style", d_graph(f"""
SELECT project_id, language, CAST(least(35, 20 + 2 * files) AS BIGINT) AS size,
  CAST(least(35, greatest(20, 3 * files)) AS BIGINT) AS page_size, {COLOR_CASE} AS color FROM langs"""))
def prj_node_style(spark, sf_dir):
    """PRJ_NODE_STYLE: server size min(20 + 2n, 35), page size clamp(3n, 20, 35), colour by language."""
    g = Graph(spark, sf_dir)
    n = F.col("files")
    return g.languages.select("project_id", "language", T.node_size(n, 20, 35).alias("size"),
                              F.least(F.lit(35), F.greatest(F.lit(20), n * 3)).cast("bigint").alias("page_size"),
                              T.language_color(F.col("language")).alias("color"))


@query("join_graph_nodes", d_graph("SELECT * FROM nodes"))
def join_graph_nodes(spark, sf_dir):
    return Graph(spark, sf_dir).nodes()


D_FW = ("fw", f"""SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, language, framework FROM text_fw
  UNION SELECT 'src' || CAST(project_id % 20 AS VARCHAR), f.language, f.framework FROM ({D_NPM}) d
  JOIN (VALUES {d_framework_names()}) AS f(dep, framework, language) ON d.name = f.dep""")
D_ERRROW = ("errrow", f"""SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, coalesce(nullif(file, ''), 'unknown') AS file, seq, message
FROM ({D_ACTIVE}) a""")
D_DEPROW = ("deprow", f"""SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, 'javascript' AS language, name FROM ({D_NPM}) d""")
D_EXTS = ", ".join(f"({sql_str(k)}, {i + 1}, {sql_str(e)})" for k, _, exts, _, _ in PR.LANGUAGES for i, e in enumerate(exts))


@query("join_graph_node_metadata", duckdb_with([*VIEWS, "framework_manifests"], [*GRAPH_CTES, D_TEXT_FW, D_FW, D_ERRROW, D_DEPROW]) + f"""
SELECT project_id, node_id, field, CAST(place AS BIGINT) AS place, value FROM (
SELECT p.project_id, 'project' AS node_id, 'health_score' AS field, 0 AS place,
  CAST(greatest(0, 100 - 10 * coalesce(h.e, 0) - 3 * coalesce(h.w, 0)) AS VARCHAR) AS value FROM (SELECT DISTINCT project_id FROM files) p
  LEFT JOIN (SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, count_if(type = 'error') AS e, count_if(type = 'warning') AS w
             FROM ({D_ACTIVE}) a GROUP BY 1) h USING (project_id)
UNION ALL SELECT project_id, 'project', 'total_files', 0, CAST(count(*) AS VARCHAR) FROM files WHERE {D_STRUCT} GROUP BY 1
UNION ALL SELECT project_id, 'project', 'total_size', 0, CAST(CAST(sum(strlen(content)) AS BIGINT) AS VARCHAR) FROM files WHERE {D_STRUCT} GROUP BY 1
UNION ALL SELECT project_id, 'lang-' || language, 'file_count', 0, CAST(files AS VARCHAR) FROM langs
UNION ALL SELECT project_id, 'lang-' || language, 'line_count', 0, CAST(lines AS VARCHAR) FROM langs
UNION ALL SELECT l.project_id, 'lang-' || l.language, 'frameworks', row_number() OVER (PARTITION BY l.project_id, l.language ORDER BY framework), framework
  FROM langs l JOIN fw USING (project_id, language)
UNION ALL SELECT l.project_id, 'lang-' || l.language, 'extensions', x.i, x.ext FROM langs l JOIN (VALUES {D_EXTS}) AS x(language, i, ext) USING (language)
UNION ALL SELECT project_id, 'service-' || service_id, unnest(['language', 'framework', 'port', 'status', 'start_command']), 0,
  unnest([language, framework, CAST(port AS VARCHAR), status, start_command]) FROM svc
UNION ALL SELECT project_id, 'error-' || file, unnest(['file', 'error_count']), 0, unnest([file, CAST(errors AS VARCHAR)]) FROM errf
UNION ALL SELECT project_id, 'error-' || file, 'errors', r, message FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, file ORDER BY seq, message) AS r FROM errrow) e WHERE r <= 5
UNION ALL SELECT project_id, 'deps-' || language, unnest(['language', 'dependency_count']), 0, unnest([language, CAST(dependencies AS VARCHAR)])
  FROM depg WHERE dependencies > 5
UNION ALL SELECT project_id, 'deps-' || language, 'dependencies', r, name FROM (
  SELECT d.*, row_number() OVER (PARTITION BY d.project_id, d.language ORDER BY name) AS r FROM deprow d JOIN depg g
  ON g.project_id = d.project_id AND g.language = d.language AND g.dependencies > 5) e WHERE r <= 10
) m WHERE value IS NOT NULL""")
def join_graph_node_metadata(spark, sf_dir):
    return Graph(spark, sf_dir).metadata()


@query("join_graph_links", d_graph("""
SELECT l.* FROM links l WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.project_id = l.project_id AND n.node_id = l.source)
  AND EXISTS (SELECT 1 FROM nodes n WHERE n.project_id = l.project_id AND n.node_id = l.target)"""))
def join_graph_links(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return T.connected_links(g.links(), g.nodes())


@query("agg_graph_meta", d_graph("""
SELECT n.project_id, n.nodes, coalesce(k.links, 0) AS links, n.languages, n.services, n.error_nodes, n.dependency_nodes FROM (
  SELECT project_id, CAST(count(*) AS BIGINT) AS nodes, CAST(count_if(node_type = 'language') AS BIGINT) AS languages,
    CAST(count_if(node_type = 'service') AS BIGINT) AS services, CAST(count_if(node_type = 'error') AS BIGINT) AS error_nodes,
    CAST(count_if(node_type = 'dependencies') AS BIGINT) AS dependency_nodes FROM nodes GROUP BY project_id) n
LEFT JOIN (SELECT project_id, CAST(count(*) AS BIGINT) AS links FROM links GROUP BY project_id) k USING (project_id)"""))
def agg_graph_meta(spark, sf_dir):
    g = Graph(spark, sf_dir)
    nodes = g.nodes()
    t = F.col("node_type")
    n = nodes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(t == "language").cast("bigint").alias("languages"),
        F.count_if(t == "service").cast("bigint").alias("services"), F.count_if(t == "error").cast("bigint").alias("error_nodes"),
        F.count_if(t == "dependencies").cast("bigint").alias("dependency_nodes"))
    k = g.links().groupBy("project_id").agg(F.count(F.lit(1)).alias("links"))
    return (n.join(k, "project_id", "left").fillna(0, ["links"])
            .select("project_id", "nodes", "links", "languages", "services", "error_nodes", "dependency_nodes"))
