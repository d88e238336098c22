"""Services, ports and the project graph (nodes and links).

Every input here is already per project and small per project (languages,
services, error files, dependency groups); the graph is unions of
projections, and the page variant keeps only links whose two ends exist
(two semi-joins on node ids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions.text import map_lookup

# ---- FIXED VALUES: language colours, status colours, default ports per language ----
LANGUAGE_COLORS = {
    "javascript": "#f7df1e", "typescript": "#3178c6", "python": "#3776ab", "go": "#00add8", "java": "#ed8b00",
    "csharp": "#239120", "rust": "#000000", "php": "#777bb4", "ruby": "#cc342d",
}
DEFAULT_COLOR = "#64ffda"
STATUS_COLORS = {"running": "#4caf50", "error": "#f44336"}
WARNING_COLOR = "#ff9800"
DEFAULT_PORTS = {
    "javascript": [3000, 3001, 8080, 8000], "typescript": [3000, 3001, 8080, 8000], "python": [8000, 5000, 8080, 9000],
    "go": [8080, 8000, 3000, 9000], "java": [8080, 8443, 9090, 8000], "csharp": [5000, 5001, 8080, 443],
    "rust": [8080, 8000, 3000, 8888], "php": [8000, 8080, 80, 443], "ruby": [3000, 4567, 8080, 9292],
}
# package.json framework priority: (dependency, framework, default port)
SERVICE_FRAMEWORKS = [("react", "react", 3000), ("vue", "vue", 8080), ("@angular/core", "angular", 4200),
                      ("express", "express", 3000), ("next", "next", 3000)]


def node_size(count: Column, lo: int, hi: int) -> Column:
    """PRJ_NODE_STYLE: min(lo + 2 x count, hi)."""
    return F.least(F.lit(hi), F.lit(lo) + count * 2).cast("bigint")


def language_color(lang: Column) -> Column:
    return map_lookup(LANGUAGE_COLORS, F.lower(lang), DEFAULT_COLOR)


def package_services(manifests: DataFrame, ports: DataFrame, project: Column) -> DataFrame:
    """JOIN_SERVICES / JOIN_PORTS: one service per package.json: framework by priority, port, status, start command."""
    from codelens.functions.joins import broadcast_if_small
    from codelens.operators.deps import MANIFEST_SCHEMA
    p = manifests.withColumn("pkg", F.from_json("content", MANIFEST_SCHEMA)).where(F.col("pkg").isNotNull())
    deps = F.col("pkg.dependencies")
    fw = F.lit("unknown")
    port = F.lit(3000)
    for dep, name, default in reversed(SERVICE_FRAMEWORKS):
        has = F.coalesce(F.map_contains_key(deps, F.lit(dep)), F.lit(False))
        fw = F.when(has, F.lit(name)).otherwise(fw)
        port = F.when(has, F.lit(default)).otherwise(port)
    scripts = F.col("pkg.scripts")
    start = F.coalesce(
        F.when(F.try_element_at(scripts, F.lit("start")).isNotNull(),
               F.format_string("npm run start (%s)", F.try_element_at(scripts, F.lit("start")))),
        F.when(F.try_element_at(scripts, F.lit("dev")).isNotNull(),
               F.format_string("npm run dev (%s)", F.try_element_at(scripts, F.lit("dev")))))
    svc = p.select(project.alias("project_id"), F.concat(F.lit("js-"), F.col("pkg.name")).alias("service_id"),
                   F.col("pkg.name").alias("name"), F.lit("javascript").alias("language"), fw.alias("framework"),
                   port.cast("bigint").alias("port"), start.alias("start_command"))
    listening = broadcast_if_small(ports.select(F.col("port").cast("bigint").alias("_lp")).distinct())
    return (svc.join(listening, svc["port"] == listening["_lp"], "left")
            .withColumn("status", F.when(F.col("_lp").isNotNull(), "running").otherwise("stopped")).drop("_lp"))


def generic_port_services(languages: DataFrame, ports: DataFrame) -> DataFrame:
    """JOIN_PORTS: a generic service per detected language whose default port is listening (exact match)."""
    dim = F.create_map(*[x for k, v in DEFAULT_PORTS.items()
                         for x in (F.lit(k), F.array(*[F.lit(p).cast("bigint") for p in v]))])
    lp = ports.select(F.col("port").cast("bigint").alias("port")).distinct()
    cand = languages.select("project_id", "language",
                            F.explode(F.try_element_at(dim, F.col("language"))).alias("port"))
    from codelens.functions.joins import broadcast_if_small
    return cand.join(broadcast_if_small(lp), "port").select("project_id", "language", "port",
                                                      F.concat(F.col("language"), F.lit("-"), F.col("port").cast("string")).alias("service_id"))


def ts_relabel_services(services: DataFrame, languages: DataFrame) -> DataFrame:
    """JOIN_TS_SERVICES: service language becomes typescript when the project has TypeScript files."""
    ts = languages.where(F.col("language") == "typescript").select("project_id").distinct().withColumn("_ts", F.lit(True))
    return (services.join(ts, "project_id", "left")
            .withColumn("language", F.when(F.col("_ts"), F.lit("typescript")).otherwise(F.col("language"))).drop("_ts"))


def service_language_links(services: DataFrame, languages: DataFrame) -> DataFrame:
    """JOIN_SERVICE_LANG: a service implements its language when the project has that language."""
    return (services.join(languages.select("project_id", "language"), ["project_id", "language"])
            .select("project_id", F.lit("implements").alias("type"),
                    F.concat(F.lit("language-"), "language").alias("from_id"),
                    F.concat(F.lit("service-"), "service_id").alias("to_id"),
                    F.format_string("%s service using %s framework", "name", "framework").alias("description")))


def graph_nodes(health: DataFrame, languages: DataFrame, services: DataFrame, error_files: DataFrame,
                dep_groups: DataFrame) -> DataFrame:
    """JOIN_GRAPH_NODES (AI view): project, language, service, error-file and dependency nodes."""
    proj = health.select("project_id", F.lit("project").alias("node_id"), F.lit("project").alias("node_type"),
                         F.lit("Project").alias("name"), F.lit(40).cast("bigint").alias("size"),
                         F.lit(DEFAULT_COLOR).alias("color"))
    lang = languages.select("project_id", F.concat(F.lit("lang-"), "language").alias("node_id"),
                            F.lit("language").alias("node_type"), F.col("language").alias("name"),
                            node_size(F.col("files"), 20, 35).alias("size"), language_color(F.col("language")).alias("color"))
    status_color = F.coalesce(map_lookup(STATUS_COLORS, F.col("status")), F.lit(WARNING_COLOR))
    svc = services.select("project_id", F.concat(F.lit("service-"), "service_id").alias("node_id"),
                          F.lit("service").alias("node_type"), "name", F.lit(25).cast("bigint").alias("size"),
                          status_color.alias("color"))
    err = error_files.select("project_id", F.concat(F.lit("error-"), "file").alias("node_id"),
                             F.lit("error").alias("node_type"),
                             F.format_string("%s (%d errors)", "file", "errors").alias("name"),
                             node_size(F.col("errors"), 15, 30).alias("size"), F.lit("#f44336").alias("color"))
    deps = dep_groups.where(F.col("dependencies") > 5).select(
        "project_id", F.concat(F.lit("deps-"), "language").alias("node_id"), F.lit("dependencies").alias("node_type"),
        F.format_string("%s Dependencies (%d)", "language", "dependencies").alias("name"),
        node_size(F.col("dependencies"), 18, 28).alias("size"), F.lit("#4caf50").alias("color"))
    return proj.unionByName(lang).unionByName(svc).unionByName(err).unionByName(deps)


def _entries(rows: DataFrame, node_id: Column, fields: list[str]) -> DataFrame:
    """One metadata row per non-null field (place 0) of each node."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(0).cast("bigint").alias("place"), F.col(f).cast("string").alias("value")) for f in fields])
    return (rows.select("project_id", node_id.alias("node_id"), F.inline(entries)).where(F.col("value").isNotNull()))


def _listed(rows: DataFrame, node_id: Column, field: str, place: Column, value: Column) -> DataFrame:
    return rows.select("project_id", node_id.alias("node_id"), F.lit(field).alias("field"), place.cast("bigint").alias("place"), value.alias("value"))


def graph_node_metadata(projects: DataFrame, languages: DataFrame, services: DataFrame, errors: DataFrame, dependencies: DataFrame,
                        extensions: dict[str, list[str]], first_errors: int = 5, first_dependencies: int = 10, more_than: int = 5) -> DataFrame:
    """JOIN_GRAPH_NODES metadata as rows (project_id, node_id, field, place, value): place 0 for a single value, 1.. in a list.

    ``projects`` carry health_score, total_files and total_size; ``languages``
    files, lines and an array of ``frameworks``; ``errors`` are (project_id, file,
    seq, message), of which a node lists the first; ``dependencies`` are
    (project_id, language, name). Rows without a value are left out, so no
    project's metadata is gathered into one row.
    """
    from codelens.operators.process import top_k
    lang, err, dep = (F.concat(F.lit(p), F.col(c)) for p, c in (("lang-", "language"), ("error-", "file"), ("deps-", "language")))
    suffixes = F.create_map(*[x for name, exts in extensions.items() for x in (F.lit(name), F.array(*[F.lit(e) for e in exts]))])
    spoken = languages.withColumn("file_count", F.col("files")).withColumn("line_count", F.col("lines"))
    per_file = errors.groupBy("project_id", "file").agg(F.count(F.lit(1)).alias("error_count"))
    shown = (dependencies.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("dependency_count"))
             .where(F.col("dependency_count") > more_than))
    firsts = top_k(dependencies.join(shown.select("project_id", "language"), ["project_id", "language"], "left_semi"),
                   ["project_id", "language"], [F.col("name")], first_dependencies)
    parts = [
        _entries(projects, F.lit("project"), ["health_score", "total_files", "total_size"]),
        _entries(spoken, lang, ["file_count", "line_count"]),
        *[_listed(spoken.select("project_id", "language", F.posexplode(items).alias("_at", "_item")), lang, field, F.col("_at") + 1, F.col("_item"))
          for field, items in (("frameworks", F.col("frameworks")), ("extensions", F.try_element_at(suffixes, F.col("language"))))],
        _entries(services, F.concat(F.lit("service-"), "service_id"), ["language", "framework", "port", "status", "start_command"]),
        _entries(per_file, err, ["file", "error_count"]),
        _listed(top_k(errors, ["project_id", "file"], [F.col("seq"), F.col("message")], first_errors), err, "errors", F.col("rank"), F.col("message")),
        _entries(shown, dep, ["language", "dependency_count"]),
        _listed(firsts, dep, "dependencies", F.col("rank"), F.col("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_links(languages: DataFrame, services: DataFrame, error_files: DataFrame, dep_groups: DataFrame,
                file_language: Column) -> DataFrame:
    """All links of the AI view (hierarchy 1.0, association 0.8, error 0.6, dependency 0.7)."""
    h = languages.select("project_id", F.lit("project").alias("source"), F.concat(F.lit("lang-"), "language").alias("target"),
                         F.lit("hierarchy").alias("link_type"), F.lit(1.0).alias("strength"))
    a = services.select("project_id", F.concat(F.lit("lang-"), "language").alias("source"),
                        F.concat(F.lit("service-"), "service_id").alias("target"),
                        F.lit("association").alias("link_type"), F.lit(0.8).alias("strength"))
    e = error_files.select("project_id", F.concat(F.lit("lang-"), file_language).alias("source"),
                           F.concat(F.lit("error-"), "file").alias("target"),
                           F.lit("error").alias("link_type"), F.lit(0.6).alias("strength"))
    d = dep_groups.where(F.col("dependencies") > 5).select(
        "project_id", F.concat(F.lit("lang-"), "language").alias("source"), F.concat(F.lit("deps-"), "language").alias("target"),
        F.lit("dependency").alias("link_type"), F.lit(0.7).alias("strength"))
    return h.unionByName(a).unionByName(e).unionByName(d)


def connected_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Page variant: drop links naming a missing node (semi-joins on both ends)."""
    ids = nodes.select("project_id", "node_id")
    src = ids.withColumnRenamed("node_id", "source")
    dst = ids.withColumnRenamed("node_id", "target")
    return links.join(src, ["project_id", "source"], "left_semi").join(dst, ["project_id", "target"], "left_semi")
