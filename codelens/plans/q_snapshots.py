"""Snapshot queries: version forest, listings, diffs, checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import process as P
from codelens.operators import snapshots as S
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.registry import Views, query
from codelens.sinks import snapshots as SK
from codelens.sources.files import SNAPSHOT_SCHEMA

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

D_WALK = [
    ("nodes", """SELECT s.snapshot_id, CASE WHEN p.snapshot_id IS NULL THEN NULL ELSE s.parent_id END AS parent_id
FROM snapshots s LEFT JOIN snapshots p ON s.parent_id = p.snapshot_id"""),
    ("walk", """SELECT snapshot_id, [snapshot_id] AS path FROM nodes WHERE parent_id IS NULL
UNION ALL
SELECT n.snapshot_id, list_append(w.path, n.snapshot_id) FROM nodes n JOIN walk w ON n.parent_id = w.snapshot_id"""),
    ("kids", """SELECT n.snapshot_id, CAST(count(c.snapshot_id) AS BIGINT) AS children
FROM nodes n LEFT JOIN nodes c ON c.parent_id = n.snapshot_id GROUP BY n.snapshot_id"""),
]


def d_forest(body: str) -> str:
    return duckdb_with(["snapshots"], D_WALK, recursive=True) + body


def _snap(spark, sf_dir):
    return Views(spark, sf_dir)("snapshots")


def _lineage(spark, sf_dir, with_path=True):
    return S.lineage(_snap(spark, sf_dir), with_path=with_path)


@query("join_lineage", d_forest("""
SELECT snapshot_id, CAST(len(path) AS BIGINT) AS depth, path[1] AS root_id, array_to_string(path, '>') AS path FROM walk"""))
def join_lineage(spark, sf_dir):
    lin = _lineage(spark, sf_dir)
    return lin.select("snapshot_id", "depth", "root_id",
                      F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("join_descendants", d_forest("""
SELECT ancestor_id, descendant_id, levels_below,
  CAST(row_number() OVER (PARTITION BY ancestor_id ORDER BY path) AS BIGINT) AS preorder FROM (
  SELECT a.ancestor_id, w.snapshot_id AS descendant_id, CAST(len(w.path) - a.pos AS BIGINT) AS levels_below, w.path
  FROM walk w, LATERAL (SELECT unnest(w.path) AS ancestor_id, generate_subscripts(w.path, 1) AS pos) a
  WHERE a.ancestor_id <> w.snapshot_id) x"""))
def join_descendants(spark, sf_dir):
    """JOIN_DESCENDANTS: every (ancestor, descendant) pair with depth below and pre-order position (children by id)."""
    return S.descendants(S.euler_tour(_snap(spark, sf_dir)))


@query("agg_branches", d_forest("""
SELECT snapshot_id, children, children > 1 AS is_branch_point, children = 0 AS is_leaf FROM kids"""))
def agg_branches(spark, sf_dir):
    return S.branches(_snap(spark, sf_dir))


@query("agg_version_stats", d_forest("""
SELECT CAST(count(*) AS BIGINT) AS total_snapshots, CAST(count_if(len(w.path) = 1) AS BIGINT) AS root_snapshots,
  CAST(count_if(k.children > 1) AS BIGINT) AS branch_points, CAST(max(len(w.path)) AS BIGINT) AS max_depth,
  round(avg(len(w.path)), 6) AS average_depth
FROM walk w JOIN kids k USING (snapshot_id)"""))
def agg_version_stats(spark, sf_dir):
    snaps = _snap(spark, sf_dir)
    lin = S.lineage(snaps, with_path=False)
    return (S.version_stats(lin.select("snapshot_id", "depth"), S.branches(snaps))
            .withColumn("average_depth", F.round("average_depth", 6)))


@query("agg_snapshot_stats", duckdb_with(["snapshots"]) + """
SELECT project_id, CAST(count(*) AS BIGINT) AS total,
  CAST(count_if(created_at > (SELECT max(created_at) FROM snapshots) - INTERVAL 7 DAYS) AS BIGINT) AS last_7_days,
  CAST(sum(size) AS BIGINT) AS total_size FROM snapshots GROUP BY project_id""")
def agg_snapshot_stats(spark, sf_dir):
    snaps = _snap(spark, sf_dir)
    return S.recent_stats(snaps, snaps.select(F.max("created_at")).scalar())


@query("srt_timeline", duckdb_with(["snapshots"]) + f"""
SELECT project_id, snapshot_id, {duck.ts_text('created_at')} AS created_at, CAST(r AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, snapshot_id DESC) AS r FROM snapshots) s
WHERE r <= 5""")
def srt_timeline(spark, sf_dir):
    t = P.top_k(_snap(spark, sf_dir), ["project_id"], [F.col("created_at").desc(), F.col("snapshot_id").desc()], 5)
    return t.select("project_id", "snapshot_id", F.date_format("created_at", TS_FMT).alias("created_at"), "rank")


def snapshot_versions(spark, sf_dir):
    """SNP_FORK over the forest: version = depth, tags = v<version> .. v2 then 'initial', parent in related."""
    lin = _lineage(spark, sf_dir, with_path=False)
    snaps = _snap(spark, sf_dir)
    tags = F.concat(F.transform(F.sequence(F.col("depth"), F.lit(2).cast("bigint"), F.lit(-1).cast("bigint")),
                                lambda v: F.concat(F.lit("v"), v.cast("string"))),
                    F.array(F.lit("initial")))
    tags = F.when(F.col("depth") >= 2, tags).otherwise(F.array(F.lit("initial")))
    return (snaps.join(lin.select("snapshot_id", "depth"), "snapshot_id")
            .withColumn("version", F.col("depth")).withColumn("tags", tags))


@query("snp_fork", d_forest("""
SELECT w.snapshot_id, CAST(n.parent_id AS VARCHAR) AS parent_id, CAST(len(w.path) AS BIGINT) AS version,
  array_to_string(list_concat(CASE WHEN len(w.path) >= 2 THEN list_transform(range(len(w.path), 1, -1), lambda v: 'v' || CAST(v AS VARCHAR))
    ELSE [] END, ['initial']), ',') AS tags,
  CASE WHEN n.parent_id IS NULL THEN '' ELSE CAST(n.parent_id AS VARCHAR) END AS related
FROM walk w JOIN nodes n USING (snapshot_id)"""))
def snp_fork(spark, sf_dir):
    v = snapshot_versions(spark, sf_dir)
    edges = S.forest_edges(_snap(spark, sf_dir)).select(F.col("node").alias("snapshot_id"), F.col("parent").alias("pid"))
    return (v.join(edges, "snapshot_id")
            .select("snapshot_id", F.col("pid").cast("string").alias("parent_id"), "version", F.array_join("tags", ",").alias("tags"),
                    F.coalesce(F.col("pid").cast("string"), F.lit("")).alias("related")))


@query("srt_snapshot_list", d_forest(f"""
SELECT s.snapshot_id, {duck.ts_text('s.created_at')} AS created_at, CAST(len(w.path) AS BIGINT) AS version, s.size,
  array_to_string(list_slice(list_concat(CASE WHEN len(w.path) >= 2 THEN list_transform(range(len(w.path), 1, -1), lambda v: 'v' || CAST(v AS VARCHAR))
    ELSE [] END, ['initial']), 1, 3), ',') ||
  CASE WHEN len(w.path) > 3 THEN ' +' || CAST(len(w.path) - 3 AS VARCHAR) || ' more' ELSE '' END AS tags_shown
FROM snapshots s JOIN walk w USING (snapshot_id)"""))
def srt_snapshot_list(spark, sf_dir):
    v = snapshot_versions(spark, sf_dir)
    shown = F.concat(F.array_join(F.slice("tags", 1, 3), ","),
                     F.when(F.size("tags") > 3, F.concat(F.lit(" +"), (F.size("tags") - 3).cast("string"), F.lit(" more")))
                     .otherwise(F.lit("")))
    return v.select("snapshot_id", F.date_format("created_at", TS_FMT).alias("created_at"), "version", "size",
                    shown.alias("tags_shown"))


# ------------------------------------------------------------ whole snapshots

def _upto(key, n: int):
    """0 .. (key mod n) - 1 as an array (empty for 0)."""
    return F.when(key % n > 0, F.sequence(F.lit(0), (key % n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _pick(values: list[str], key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def snapshot_docs(spark, sf_dir):
    """Every snapshot as a whole stored row (see ``sources.files.SNAPSHOT_SCHEMA``), derived from the snapshots view."""
    s, none = F.col("snapshot_id"), F.lit(None)
    at = F.col("created_at").cast("timestamp")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    questions = F.transform(_upto(s, 4), lambda k: F.struct(
        text("q", k), text('Why does "step ', k, '" fail <', s, "> & how?"), _pick(["high", "medium", "low"], k), _pick(["open", "investigating", "answered"], s + k), at, none,
        F.when((s + k) % 3 == 2, text("see run ", k)).otherwise(""), _pick(["human", "ai"], k)))
    hypotheses = F.transform(_upto(s + 1, 3), lambda k: F.struct(
        text("h", k), text("cause ", k, " of ", s), (s % 100) / 100.0, F.transform(_upto(s + k, 3), lambda e: text("log\t", e)),
        _pick(["active", "confirmed", "refuted"], s + k), at, none))
    findings = F.transform(_upto(s + 2, 3), lambda k: F.struct(
        text("f", k), text("fact ", k), text("seen in ", s), _pick(["high", "low"], k), _pick(["bug", "performance"], s + k),
        F.array(F.struct(F.lit("log"), F.lit("app.log"), text("line ", k), at)), at, (s + k) % 2 == 0))
    blockers = F.transform(_upto(s + 3, 4), lambda k: F.struct(
        text("b", k), text("missing ", k), text("needs \\", s), _pick(["critical", "low"], s), _pick(["technical", "knowledge"], k), _pick(["open", "investigating", "resolved"], s + k), at, none,
        F.when((s + k) % 3 == 2, F.lit("granted")).otherwise("")))
    investigation = F.struct(
        text("errors of ", F.col("project_id")), F.slice(F.array(F.lit("find the cause"), F.lit("fix it")), 1, (s % 3).cast("int")),
        _pick(["discovery", "analysis"], s), questions, hypotheses, findings, F.slice(F.array(F.lit("bisect"), F.lit("add a test")), 1, ((s + 1) % 3).cast("int")), blockers)
    recommendations = F.transform(_upto(s, 6), lambda k: F.struct(text("r", k), F.lit("action"), text("try ", k), F.lit("d"), F.lit(0.5), F.lit("high"), F.lit("pending"), at, none, none))
    decisions = F.transform(_upto(s, 3), lambda k: F.struct(text("d", k), text("go ", k), F.lit("r"), F.lit("low"), F.lit("direction"), at, F.lit("")))
    collaboration = F.struct(text("session_", F.col("project_id")), (s % 40).cast("int"), at, recommendations, decisions, none, none,
                             F.create_map(F.lit("read"), (s % 7).cast("int"), F.lit("search"), (s % 3).cast("int")))
    metadata = F.struct(F.array(F.lit("initial")), text("/work/p", F.col("project_id")), none, F.lit("main"), none, none, none,
                        F.when(F.col("parent_id").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("parent_id").cast("string"))),
                        F.array(F.lit("json"), F.lit("markdown")))
    state = F.when(s % 5 > 0, F.struct((s % 101).cast("int"), s % 500, s % 9, s % 4))
    values = {
        "id": s.cast("string"), "name": text('Case "', s, '" <', F.col("project_id"), ">"), "description": text("project ", F.col("project_id"), "\nsecond line"),
        "created_at": at, "updated_at": at + F.make_dt_interval(hours=(s % 50).cast("int")), "version": (s % 5 + 1).cast("int"),
        "parent_snapshot_id": F.col("parent_id").cast("string"), "project_state": state, "investigation": investigation,
        "collaboration": collaboration, "metadata": metadata}
    kinds = spark.createDataFrame([], SNAPSHOT_SCHEMA).schema
    return _snap(spark, sf_dir).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in kinds])


# the same rows written by hand for the oracle: lists of structs, without the fields that are empty
D_DOCS = ("docs", r"""SELECT *, CAST(snapshot_id AS VARCHAR) AS id, snapshot_id AS s, CAST(snapshot_id AS VARCHAR) AS t, CAST(project_id AS VARCHAR) AS p,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS made, strftime(created_at, '%Y-%m-%d %H:%M') AS minute,
  strftime(created_at + to_hours(snapshot_id % 50), '%Y-%m-%d %H:%M:%S') AS updated, snapshot_id % 5 + 1 AS version FROM snapshots""")
D_PARTS = ("parts", r"""SELECT *, 'Case "' || t || '" <' || p || '>' AS name, 'project ' || p || chr(10) || 'second line' AS description,
  list_slice(['find the cause', 'fix it'], 1, s % 3) AS goals, list_slice(['bisect', 'add a test'], 1, (s + 1) % 3) AS next_steps,
  list_transform(range(0, s % 4), lambda k: {'id': 'q' || k, 'question': 'Why does "step ' || k || '" fail <' || t || '> & how?',
    'priority': ['high', 'medium', 'low'][k % 3 + 1], 'status': ['open', 'investigating', 'answered'][(s + k) % 3 + 1], 'created_at': made,
    'answer': CASE WHEN (s + k) % 3 = 2 THEN 'see run ' || k ELSE '' END, 'source': ['human', 'ai'][k % 2 + 1]}) AS questions,
  list_transform(range(0, (s + 1) % 3), lambda k: {'id': 'h' || k, 'statement': 'cause ' || k || ' of ' || t, 'confidence': CAST((s % 100) / 100.0 AS DOUBLE),
    'evidence': list_transform(range(0, (s + k) % 3), lambda e: 'log' || chr(9) || e), 'status': ['active', 'confirmed', 'refuted'][(s + k) % 3 + 1], 'created_at': made}) AS hypotheses,
  list_transform(range(0, (s + 2) % 3), lambda k: {'id': 'f' || k, 'title': 'fact ' || k, 'description': 'seen in ' || t, 'impact': ['high', 'low'][k % 2 + 1],
    'category': ['bug', 'performance'][(s + k) % 2 + 1], 'evidence': [{'type': 'log', 'source': 'app.log', 'content': 'line ' || k, 'timestamp': made}],
    'created_at': made, 'verified': (s + k) % 2 = 0}) AS findings,
  list_transform(range(0, (s + 3) % 4), lambda k: {'id': 'b' || k, 'title': 'missing ' || k, 'description': 'needs \' || t, 'severity': ['critical', 'low'][s % 2 + 1],
    'type': ['technical', 'knowledge'][k % 2 + 1], 'status': ['open', 'investigating', 'resolved'][(s + k) % 3 + 1], 'created_at': made,
    'resolution': CASE WHEN (s + k) % 3 = 2 THEN 'granted' ELSE '' END}) AS blockers,
  list_transform(range(0, s % 6), lambda k: {'id': 'r' || k, 'type': 'action', 'title': 'try ' || k, 'description': 'd', 'confidence': CAST(0.5 AS DOUBLE), 'priority': 'high', 'status': 'pending', 'created_at': made}) AS recommendations,
  list_transform(range(0, s % 3), lambda k: {'id': 'd' || k, 'decision': 'go ' || k, 'rationale': 'r', 'impact': 'low', 'category': 'direction', 'created_at': made, 'outcome': ''}) AS decisions,
  CASE WHEN parent_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE [CAST(parent_id AS VARCHAR)] END AS related FROM docs""")
D_BODY = ("bodies", r"""SELECT *,
  to_json({'focus': 'errors of ' || p, 'goals': goals, 'current_phase': ['discovery', 'analysis'][s % 2 + 1], 'questions': questions, 'hypotheses': hypotheses, 'findings': findings, 'next_steps': next_steps, 'blockers': blockers}) AS investigation,
  to_json({'session_id': 'session_' || p, 'interaction_count': s % 40, 'last_interaction': made, 'ai_recommendations': recommendations, 'human_decisions': decisions, 'tool_usage': {'read': s % 7, 'search': s % 3}}) AS collaboration,
  CASE WHEN s % 5 > 0 THEN to_json({'health_score': s % 101, 'total_files': s % 500, 'active_errors': s % 9, 'languages': s % 4}) END AS state,
  '{"tags":["initial"],"project_path":' || to_json('/work/p' || p) || ',"git_branch":"main"' AS meta_head,
  ',"related_snapshots":' || to_json(related) || ',"export_formats":["json","markdown"]}' AS meta_tail FROM parts""")
D_CONTENT = ("contents", r"""SELECT *, '{"id":' || to_json(id) || ',"name":' || to_json(name) || ',"description":' || to_json(description) || ',"created_at":' || to_json(made) ||
  ',"version":' || version || CASE WHEN parent_id IS NULL THEN '' ELSE ',"parent_snapshot_id":' || to_json(CAST(parent_id AS VARCHAR)) END ||
  coalesce(',"project_state":' || state, '') || ',"investigation":' || investigation || ',"collaboration":' || collaboration || ',"metadata":' || meta_head || meta_tail || '}' AS content FROM bodies""")
D_WHOLE = [D_DOCS, D_PARTS, D_BODY, D_CONTENT]


@query("snp_checksum", duckdb_with(["snapshots"], D_WHOLE) + """
SELECT id AS snapshot_id, CAST(strlen(content) AS BIGINT) AS json_bytes, sha256(content) AS checksum FROM contents""")
def snp_checksum(spark, sf_dir):
    """SNP_CHECKSUM: size and SHA-256 of each whole snapshot's JSON (content only, so it is reproducible)."""
    saved = SK.with_metadata(snapshot_docs(spark, sf_dir))
    return saved.select(F.col("id").alias("snapshot_id"), F.col("metadata.size").alias("json_bytes"), F.col("metadata.checksum").alias("checksum"))


@query("snk_export_json", duckdb_with(["snapshots"], D_WHOLE) + """
SELECT id AS snapshot_id, '{"snapshot_id":' || to_json(id) || ',"name":' || to_json(name) || ',"description":' || to_json(description) || ',"created_at":' || to_json(made) ||
  ',"updated_at":' || to_json(updated) || ',"version":' || version || ',"investigation":' || investigation || ',"metadata":' || meta_head ||
  ',"size":' || strlen(content) || ',"checksum":' || to_json(sha256(content)) || meta_tail || coalesce(',"project_state":' || state, '') || ',"collaboration":' || collaboration || '}' AS json
FROM contents""")
def snk_export_json(spark, sf_dir):
    """SNK_EXPORT_JSON: each snapshot as one JSON document, with its saved size and checksum."""
    docs = snapshot_docs(spark, sf_dir)
    return SK.export_json(SK.with_metadata(docs, F.col("updated_at"))).withColumnRenamed("id", "snapshot_id")


D_MD = ("md", r"""SELECT id, name, '# Investigation Snapshot: ' || name || E'

**Created:** ' || made || E'  
**Updated:** ' || updated || E'  
**Version:** ' || version ||
  E'  
**Description:** ' || description || E'

## 🔍 Investigation Context

**Focus:** errors of ' || p || E'  
**Current Phase:** ' || ['discovery', 'analysis'][s % 2 + 1] || E'  
' ||
  CASE WHEN len(goals) > 0 THEN E'
### Goals
' || array_to_string(list_transform(range(1, len(goals) + 1), lambda i: i || '. ' || goals[i] || E'
'), '') ELSE '' END ||
  CASE WHEN len(questions) > 0 THEN E'
## ❓ Questions

' || array_to_string(list_transform(questions, lambda q:
    '### ' || CASE q.status WHEN 'answered' THEN '✅' WHEN 'investigating' THEN '🔍' ELSE '🔓' END || ' ' || q.question || E'
- **Priority:** ' || q.priority ||
    E'
- **Source:** ' || q.source || E'
- **Created:** ' || minute || E'
' || CASE WHEN q.answer <> '' THEN '- **Answer:** ' || q.answer || E'
' ELSE '' END || E'
'), '') ELSE '' END ||
  CASE WHEN len(hypotheses) > 0 THEN E'
## 💡 Hypotheses

' || array_to_string(list_transform(hypotheses, lambda h:
    '### ' || CASE h.status WHEN 'confirmed' THEN '✅' WHEN 'refuted' THEN '❌' ELSE '🔬' END || ' ' || h.statement || E'
- **Confidence:** ' || printf('%.2f', h.confidence) ||
    E'
- **Status:** ' || h.status || E'
- **Created:** ' || minute || E'
' || CASE WHEN len(h.evidence) > 0 THEN E'- **Evidence:**
' ||
    array_to_string(list_transform(h.evidence, lambda e: '  - ' || e || E'
'), '') ELSE '' END || E'
'), '') ELSE '' END ||
  CASE WHEN len(findings) > 0 THEN E'
## 🎯 Findings

' || array_to_string(list_transform(findings, lambda f:
    '### ' || CASE WHEN f.verified THEN '✅' ELSE '⏳' END || ' ' || f.title || E'
**Description:** ' || f.description || E'

- **Impact:** ' || f.impact ||
    E'
- **Category:** ' || f.category || E'
- **Created:** ' || minute || E'

'), '') ELSE '' END ||
  CASE WHEN len(blockers) > 0 THEN E'
## 🚧 Blockers

' || array_to_string(list_transform(blockers, lambda b:
    '### ' || CASE b.status WHEN 'resolved' THEN '✅' WHEN 'investigating' THEN '🔍' ELSE '🔴' END || ' ' || b.title || E'
**Description:** ' || b.description || E'

- **Severity:** ' ||
    b.severity || E'
- **Type:** ' || b.type || E'
- **Created:** ' || minute || E'
' || CASE WHEN b.resolution <> '' THEN '- **Resolution:** ' || b.resolution || E'
' ELSE '' END || E'
'), '') ELSE '' END ||
  CASE WHEN len(next_steps) > 0 THEN E'
## 📋 Next Steps

' || array_to_string(list_transform(range(1, len(next_steps) + 1), lambda i: i || '. ' || next_steps[i] || E'
'), '') || E'
' ELSE '' END ||
  E'
## 🤝 Collaboration Summary

- **Session ID:** session_' || p || E'
- **Interactions:** ' || s % 40 || E'
- **Last Interaction:** ' || minute ||
  E'
- **AI Recommendations:** ' || len(recommendations) || E'
- **Human Decisions:** ' || len(decisions) || E'
' ||
  CASE WHEN s % 5 > 0 THEN E'
## 📊 Project State

- **Health Score:** ' || s % 101 || E'/100
- **Total Files:** ' || s % 500 || E'
- **Active Errors:** ' || s % 9 ||
    E'
- **Languages:** ' || s % 4 || E'
' ELSE '' END ||
  E'
---
*Generated on ' || updated || E'*
' AS markdown FROM parts""")


@query("snk_export_md", duckdb_with(["snapshots"], [D_DOCS, D_PARTS, D_MD]) + "SELECT id AS snapshot_id, markdown FROM md")
def snk_export_md(spark, sf_dir):
    """SNK_EXPORT_MD: each snapshot's Markdown document, every section that has entries."""
    return SK.export_markdown(snapshot_docs(spark, sf_dir), F.col("updated_at")).withColumnRenamed("id", "snapshot_id")


@query("snk_export_html", duckdb_with(["snapshots"], [D_DOCS, D_PARTS, D_MD]) + r"""
SELECT id AS snapshot_id, E'<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="UTF-8">
<meta name="viewport" content="width=device-width, initial-scale=1.0">
<title>Investigation Snapshot: ' ||
  replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || E'</title>
</head>
<body>
<pre>
' ||
  replace(replace(replace(markdown, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || E'</pre>
</body>
</html>
' AS html FROM md""")
def snk_export_html(spark, sf_dir):
    """SNK_EXPORT_HTML: the Markdown document, escaped, in a page."""
    return SK.export_html(snapshot_docs(spark, sf_dir), F.col("updated_at")).withColumnRenamed("id", "snapshot_id")


@query("join_snapshot_diff", duckdb_with(["snapshots", "snapshot_files"], D_WALK[:1], recursive=False) + """
, c AS (SELECT n.snapshot_id AS child, n.parent_id AS parent, f.path, f.line_count FROM nodes n JOIN snapshot_files f ON f.snapshot_id = n.snapshot_id WHERE n.parent_id IS NOT NULL),
p AS (SELECT n.snapshot_id AS child, n.parent_id AS parent, f.path, f.line_count FROM nodes n JOIN snapshot_files f ON f.snapshot_id = n.parent_id),
-- how many entries of each kind snapshot s has, and which of them are closed, as the documents are made
ent AS (SELECT snapshot_id AS s, snapshot_id % 4 AS q, (snapshot_id + 1) % 3 AS h, (snapshot_id + 2) % 3 AS f, (snapshot_id + 3) % 4 AS b FROM snapshots),
inv AS (SELECT c.s AS cs, greatest(c.q - p.q, 0) AS questions_added, greatest(c.h - p.h, 0) AS hypotheses_added,
    greatest(c.f - p.f, 0) AS findings_added, greatest(c.b - p.b, 0) AS blockers_added,
    CAST(len(list_filter(range(0, c.q), lambda k: (c.s + k) % 3 = 2 AND (k < p.q AND (p.s + k) % 3 <> 2))) AS BIGINT) AS questions_answered,
    CAST(len(list_filter(range(0, c.h), lambda k: (c.s + k) % 3 <> 0 AND (k < p.h AND (p.s + k) % 3 = 0))) AS BIGINT) AS hypotheses_tested,
    CAST(len(list_filter(range(0, c.b), lambda k: (c.s + k) % 3 = 2 AND (k < p.b AND (p.s + k) % 3 <> 2))) AS BIGINT) AS blockers_resolved
  FROM nodes n JOIN ent c ON c.s = n.snapshot_id JOIN ent p ON p.s = n.parent_id),
j AS (SELECT coalesce(c.child, p.child) AS child, coalesce(c.parent, p.parent) AS parent, c.line_count AS cl, p.line_count AS pl
      FROM c FULL OUTER JOIN p ON c.child = p.child AND c.path = p.path)
SELECT child AS snapshot_id, parent AS parent_id, CAST(count_if(pl IS NULL) AS BIGINT) AS files_added,
  CAST(count_if(cl IS NULL) AS BIGINT) AS files_removed, CAST(count_if(cl IS NOT NULL AND pl IS NOT NULL AND cl <> pl) AS BIGINT) AS files_modified,
  CAST(sum(abs(coalesce(cl, 0) - coalesce(pl, 0))) AS BIGINT) AS lines_changed,
  any_value(i.questions_added) AS questions_added, any_value(i.hypotheses_added) AS hypotheses_added, any_value(i.findings_added) AS findings_added,
  any_value(i.blockers_added) AS blockers_added, any_value(i.questions_answered) AS questions_answered,
  any_value(i.hypotheses_tested) AS hypotheses_tested, any_value(i.blockers_resolved) AS blockers_resolved
FROM j JOIN inv i ON i.cs = child GROUP BY child, parent""")
def join_snapshot_diff(spark, sf_dir):
    """JOIN_SNAPSHOT_DIFF: files added / removed / modified, lines changed, and the investigation's progress from parent to child."""
    edges = S.forest_edges(_snap(spark, sf_dir)).where(F.col("parent").isNotNull())
    files = Views(spark, sf_dir)("snapshot_files")
    c = edges.join(files, edges["node"] == files["snapshot_id"]).select(
        F.col("node").alias("child"), F.col("parent"), "path", F.col("line_count").alias("cl"))
    p = edges.join(files, edges["parent"] == files["snapshot_id"]).select(
        F.col("node").alias("child"), F.col("parent"), "path", F.col("line_count").alias("pl"))
    j = c.join(p, ["child", "parent", "path"], "full_outer")
    files_changed = j.groupBy(F.col("child").alias("snapshot_id"), F.col("parent").alias("parent_id")).agg(
        F.count_if(F.col("pl").isNull()).cast("bigint").alias("files_added"),
        F.count_if(F.col("cl").isNull()).cast("bigint").alias("files_removed"),
        F.count_if(F.col("cl").isNotNull() & F.col("pl").isNotNull() & (F.col("cl") != F.col("pl")))
        .cast("bigint").alias("files_modified"),
        F.sum(F.abs(F.coalesce("cl", F.lit(0)) - F.coalesce("pl", F.lit(0)))).cast("bigint").alias("lines_changed"))
    return files_changed.join(S.investigation_diff(snapshot_docs(spark, sf_dir), edges), "snapshot_id")


@query("prj_format_size", duckdb_with(["snapshots"]) + """
SELECT snapshot_id, size, CASE WHEN size = 0 THEN '0 Bytes' ELSE
  regexp_replace(printf('%.1f', round(size / pow(1024, least(floor(log(size) / log(1024)), 3)), 1)), '\\.0$', '') || ' ' ||
  ['Bytes', 'KB', 'MB', 'GB'][CAST(least(floor(log(size) / log(1024)), 3) AS INT) + 1] END AS size_text
FROM snapshots""")
def prj_format_size(spark, sf_dir):
    s = _snap(spark, sf_dir)
    return s.select("snapshot_id", "size", S.format_size(F.col("size")).alias("size_text"))
