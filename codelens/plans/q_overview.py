"""Project overview, context, quality summaries and advice queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelens.operators import deps as DP
from codelens.operators import diagnostics as D
from codelens.operators import ops as O
from codelens.operators import overview as OV
from codelens.operators import process as P
from codelens.operators import project as PR
from codelens.plans.fixtures import duckdb_with
from codelens.plans.q_deps import D_NPM, D_PKG
from codelens.plans.q_diagnostics import D_ACTIVE, D_CLASSIFIED, active_errors
from codelens.plans.q_project import D_EXT, D_LANGS, D_STRUCT, D_TESTS, D_TODOS, d_case, project_key
from codelens.plans.q_streams import D_CHANGES, D_GIT
from codelens.plans.q_topology import D_SVC, D_SVC0
from codelens.plans.registry import Views, query, sql_str

FILE_QUERY_PATH = "src/f1.ts"

STATE_VIEWS = ["files", "file_lines", "tool_output", "git_status_lines", "manifest_json", "conversations"]
D_STATE_CTES = [
    D_PKG, D_TESTS, D_LANGS, D_TODOS, D_GIT,
    ("fs", f"SELECT project_id, count(*) AS total_files, sum(strlen(content)) AS total_size FROM files WHERE {D_STRUCT} GROUP BY 1"),
    ("lc", "SELECT project_id, count(*) AS languages FROM langs GROUP BY 1"),
    ("pl", """SELECT project_id, language AS primary_language FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY files DESC, language) AS r FROM langs) x WHERE r = 1"""),
    ("pt", f"""SELECT project_id, arg_min({d_case({'package.json': 'nodejs', 'go.mod': 'go', 'requirements.txt': 'python',
      'cargo.toml': 'rust', 'pom.xml': 'java', 'composer.json': 'php'}, "lower(string_split(rel_path, '/')[-1])", None)}, rel_path) AS t
      FROM files WHERE NOT contains(rel_path, '/') AND lower(string_split(rel_path, '/')[-1]) IN
      ('package.json', 'go.mod', 'requirements.txt', 'cargo.toml', 'pom.xml', 'composer.json') GROUP BY 1"""),
    ("er", f"""SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, count(*) AS n, count_if(type = 'error') AS e,
      count_if(type = 'warning') AS w FROM ({D_ACTIVE}) a GROUP BY 1"""),
    ("gd", """SELECT 'src' || CAST(project_id AS VARCHAR) AS project_id, bool_or(category IN ('modified', 'untracked')) AS dirty,
      count_if(category = 'modified') AS modified FROM git WHERE category IS NOT NULL GROUP BY 1"""),
    ("td", "SELECT project_id, count(*) AS n FROM todos GROUP BY 1"),
    ("dp", f"SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, count(*) AS n FROM ({D_NPM}) d GROUP BY 1"),
    ("st", """SELECT fs.project_id, CAST(fs.total_files AS BIGINT) AS total_files, CAST(fs.total_size AS BIGINT) AS total_size,
      CAST(coalesce(lc.languages, 0) AS BIGINT) AS languages, coalesce(pl.primary_language, 'unknown') AS primary_language,
      coalesce(pt.t, 'unknown') AS project_type,
      CAST(greatest(0, 100 - 10 * coalesce(er.e, 0) - 3 * coalesce(er.w, 0)) AS BIGINT) AS health_score,
      CAST(coalesce(er.n, 0) AS BIGINT) AS error_count, CAST(coalesce(er.e, 0) AS BIGINT) AS errors_e,
      CAST(coalesce(er.w, 0) AS BIGINT) AS warning_count,
      CASE WHEN coalesce(er.e, 0) > 10 OR coalesce(er.w, 0) > 50 THEN 'high'
           WHEN coalesce(er.e, 0) > 5 OR coalesce(er.w, 0) > 20 THEN 'medium' ELSE 'low' END AS technical_debt,
      coalesce(gd.dirty, false) AS is_dirty, CAST(coalesce(gd.modified, 0) AS BIGINT) AS modified_files,
      CAST(coalesce(td.n, 0) AS BIGINT) AS todo_count, CAST(coalesce(dp.n, 0) AS BIGINT) AS dependency_count
    FROM fs LEFT JOIN lc USING (project_id) LEFT JOIN pl USING (project_id) LEFT JOIN pt USING (project_id)
    LEFT JOIN er USING (project_id) LEFT JOIN gd USING (project_id) LEFT JOIN td USING (project_id) LEFT JOIN dp USING (project_id)"""),
    ("tk", """SELECT conv_id AS task_id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS project_id, arg_min(text, turn) AS task
      FROM conversations WHERE role = 'user' GROUP BY conv_id"""),
]


def d_state(body: str, extra_views=(), extra=()) -> str:
    return duckdb_with(STATE_VIEWS + list(extra_views), D_STATE_CTES + list(extra)) + body


def project_state(spark, sf_dir):
    """One row per project: structure, languages, type, health, git, todos, dependencies."""
    v = Views(spark, sf_dir)
    files = v("files")
    fa = PR.with_file_attrs(files).where(PR.structure_scope(F.col("rel_path")))
    fs = fa.groupBy("project_id").agg(F.count(F.lit(1)).cast("bigint").alias("total_files"),
                                      F.sum("size").cast("bigint").alias("total_size"))
    langs = PR.detected_languages(files)
    lc = langs.groupBy("project_id").agg(F.count(F.lit(1)).cast("bigint").alias("languages"))
    pl = PR.primary_language(langs).select("project_id", "primary_language")
    pt = PR.project_type(files)
    errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    er = errs.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "error").alias("e"),
                                        F.count_if(F.col("type") == "warning").alias("w"))
    git = O.git_status_files(v("git_status_lines")).withColumn("project_id", project_key(F.col("project_id")))
    gd = git.groupBy("project_id").agg(F.max(F.col("category").isin("modified", "untracked")).alias("dirty"),
                                       F.count_if(F.col("category") == "modified").alias("modified"))
    from codelens.operators.rules import todos
    td = todos(PR.todo_lines(files, v("file_lines"))).groupBy("project_id").agg(F.count(F.lit(1)).alias("td"))
    dp = (DP.npm_dependencies(v("manifest_json")).withColumn("project_id", project_key(F.col("project_id")))
          .groupBy("project_id").agg(F.count(F.lit(1)).alias("dp")))
    j = fs
    for d in (lc, pl, pt, er, gd, td, dp):
        j = j.join(d, "project_id", "left")
    e, w = F.coalesce("e", F.lit(0)), F.coalesce("w", F.lit(0))
    debt = F.when((e > 10) | (w > 50), "high").when((e > 5) | (w > 20), "medium").otherwise("low")
    return j.select("project_id", "total_files", "total_size", F.coalesce("languages", F.lit(0)).cast("bigint").alias("languages"),
                    F.coalesce("primary_language", F.lit("unknown")).alias("primary_language"),
                    F.coalesce("project_type", F.lit("unknown")).alias("project_type"),
                    F.greatest(F.lit(0), 100 - 10 * e - 3 * w).cast("bigint").alias("health_score"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("error_count"), e.cast("bigint").alias("errors_e"),
                    w.cast("bigint").alias("warning_count"), debt.alias("technical_debt"),
                    F.coalesce("dirty", F.lit(False)).alias("is_dirty"),
                    F.coalesce("modified", F.lit(0)).cast("bigint").alias("modified_files"),
                    F.coalesce("td", F.lit(0)).cast("bigint").alias("todo_count"),
                    F.coalesce("dp", F.lit(0)).cast("bigint").alias("dependency_count"))


def conversation_tasks(spark, sf_dir):
    """Tasks: the first user turn of every conversation, assigned to project src<conv_id % 20>."""
    c = Views(spark, sf_dir)("conversations").where(F.col("role") == "user")
    return (c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("task"))
            .select(F.col("conv_id").alias("task_id"), project_key(F.col("conv_id")).alias("project_id"), "task"))


@query("agg_overview", d_state("""
SELECT project_id, languages, primary_language, health_score, total_files, total_size, error_count,
  CAST(coalesce(sv.services, 0) AS BIGINT) AS services
FROM st LEFT JOIN (SELECT project_id, count(*) AS services FROM svc GROUP BY 1) sv USING (project_id)""",
                                extra_views=["listening_ports"], extra=[D_SVC0, D_SVC]))
def agg_overview(spark, sf_dir):
    from codelens.operators.topology import package_services
    v = Views(spark, sf_dir)
    s = project_state(spark, sf_dir)
    svc = (package_services(v("manifest_json"), v("listening_ports"), project_key(F.col("project_id")))
           .groupBy("project_id").agg(F.count(F.lit(1)).alias("services")))
    return (s.join(svc, "project_id", "left")
            .select("project_id", "languages", "primary_language", "health_score", "total_files", "total_size", "error_count",
                    F.coalesce("services", F.lit(0)).cast("bigint").alias("services")))


@query("agg_recent_activity", d_state(f"""
SELECT st.project_id, CAST(coalesce(rc.n, 0) AS BIGINT) AS recent_changes, 'unknown' AS branch, st.modified_files,
  st.error_count AS error_activity FROM st LEFT JOIN (
  SELECT 'src' || regexp_extract(path, '^proj([0-9]+)/', 1) AS project_id, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY observed_at DESC, seq DESC) AS r
    FROM changes WHERE change_type IS NOT NULL) c
  WHERE r <= 100 AND observed_at > (SELECT max(observed_at) FROM changes WHERE change_type IS NOT NULL) - INTERVAL 10 MINUTES
  GROUP BY 1) rc USING (project_id)""", extra_views=["file_observations"], extra=[D_CHANGES]))
def agg_recent_activity(spark, sf_dir):
    ch = P.file_changes(Views(spark, sf_dir)("file_observations"))
    recent = P.recent_changes(ch, as_of=ch.select(F.max("observed_at")).scalar())
    rc = (recent.withColumn("project_id", F.concat(F.lit("src"), F.regexp_extract("path", r"^proj([0-9]+)/", 1)))
          .groupBy("project_id").agg(F.count(F.lit(1)).alias("n")))
    s = project_state(spark, sf_dir)
    return s.join(rc, "project_id", "left").select(
        "project_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("recent_changes"), F.lit("unknown").alias("branch"),
        "modified_files", F.col("error_count").alias("error_activity"))


@query("agg_quality_summary", d_state("""
SELECT project_id, health_score AS overall_score, errors_e AS critical_issues, warning_count AS warnings, technical_debt,
  todo_count, array_to_string(list_filter([
    CASE WHEN errors_e > 0 THEN 'Fix critical errors before proceeding with new features' END,
    CASE WHEN health_score < 80 THEN 'Consider refactoring to improve code quality' END,
    CASE WHEN todo_count > 20 THEN 'Address TODO items to reduce technical debt' END], lambda x: x IS NOT NULL), '; ') AS recommendations
FROM st"""))
def agg_quality_summary(spark, sf_dir):
    return OV.quality_summary(project_state(spark, sf_dir))


@query("prj_context_line", d_state("""
SELECT project_id, printf('📊 Project Health: %d/100', health_score) || ' | ' || printf('📁 Files: %d (%s project)', total_files, project_type)
  || ' | ' || printf('🌐 Languages: %d', languages) || ' | ' || printf('🔴 Errors: %d', error_count) || ' | ' ||
  '🌿 Git: unknown' || CASE WHEN is_dirty THEN ' (dirty)' ELSE ' (clean)' END AS context FROM st"""))
def prj_context_line(spark, sf_dir):
    return OV.context_line(project_state(spark, sf_dir))


@query("agg_context", d_state(f"""
SELECT st.project_id, CAST(e.r AS BIGINT) AS rank, e.message, st.error_count, st.todo_count, st.modified_files
FROM st JOIN (SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, message,
  row_number() OVER (PARTITION BY 'src' || CAST(project_id % 20 AS VARCHAR) ORDER BY seq) AS r FROM ({D_ACTIVE}) a) e
  USING (project_id) WHERE e.r <= 10"""))
def agg_context(spark, sf_dir):
    """AGG_CONTEXT: each project's first 10 errors with its counts (the cut is the feature)."""
    errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    first = P.top_k(errs, ["project_id"], [F.col("seq")], 10)
    s = project_state(spark, sf_dir)
    return s.join(first, "project_id").select("project_id", "rank", "message", "error_count", "todo_count", "modified_files")


D_NEXT = """list_filter([CASE WHEN error_count > 0 THEN printf('🐛 Fix %d active errors', error_count) END,
  CASE WHEN is_dirty THEN '💾 Commit pending changes' END,
  CASE WHEN health_score < 90 THEN printf('🔧 Improve code quality (current score: %d/100)', health_score) END,
  CASE WHEN dependency_count > 0 THEN '📦 Review dependencies for updates' END], lambda x: x IS NOT NULL)"""


def d_explode(keys: str, arr: str, src: str) -> str:
    return f"""SELECT {keys}, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS advice FROM (
  SELECT {keys}, {arr} AS a FROM {src}) x"""


@query("rec_next_actions", d_state(d_explode("project_id", f"""CASE WHEN len({D_NEXT}) = 0
  THEN ['✅ Project looks good! Consider adding tests or documentation'] ELSE {D_NEXT} END""", "st")))
def rec_next_actions(spark, sf_dir):
    return OV.next_actions(project_state(spark, sf_dir))


@query("rec_health", d_state(d_explode("project_id", """list_filter([
  CASE WHEN health_score < 50 THEN '🚨 Project health is critical - focus on fixing errors first'
       WHEN health_score < 80 THEN '⚠️ Project health needs attention - consider refactoring'
       ELSE '✅ Project health is good - safe to add new features' END,
  CASE WHEN error_count > 10 THEN '🐛 High error count - prioritize bug fixes over new features'
       WHEN error_count > 0 THEN printf('🔧 Fix %d active error(s) before proceeding', error_count) END,
  CASE WHEN is_dirty THEN '💾 Consider committing current changes' END,
  CASE WHEN project_type = 'go' THEN '🔍 Use ''go fmt'', ''go vet'', and ''go mod tidy'' for Go best practices'
       WHEN project_type IN ('javascript', 'typescript') THEN '🔍 Consider using ESLint, Prettier, and TypeScript checks'
       WHEN project_type = 'python' THEN '🔍 Consider using Black, Flake8, and mypy for Python' END], lambda x: x IS NOT NULL)""", "st")))
def rec_health(spark, sf_dir):
    return OV.health_advice(project_state(spark, sf_dir))


def _state_tasks(spark, sf_dir):
    return conversation_tasks(spark, sf_dir).join(project_state(spark, sf_dir), "project_id")


D_TASKSPEC = """CASE WHEN contains(lower(task), 'test') THEN ['🧪 Focus on edge cases and error conditions', '📊 Ensure good test coverage']
  WHEN contains(lower(task), 'api') OR contains(lower(task), 'endpoint') THEN ['🔒 Implement proper authentication and validation', '📝 Document API endpoints']
  WHEN contains(lower(task), 'database') OR contains(lower(task), 'db') THEN ['🛡️ Use parameterized queries to prevent SQL injection', '🚀 Consider database indexes for performance']
  WHEN contains(lower(task), 'ui') OR contains(lower(task), 'frontend') THEN ['♿ Ensure accessibility compliance', '📱 Test responsive design']
  ELSE [] END"""


@query("rec_coding_steps", d_state(d_explode("project_id, task_id", f"""list_filter(list_concat(
  CASE WHEN health_score < 30 THEN list_concat(['🆘 Critical: Project health is very low - focus on error resolution'],
         list_transform({D_NEXT}[1:2], lambda a: '🔧 ' || a))
       WHEN health_score < 70 THEN ['⚠️ Moderate issues detected - balance fixes with development',
         CASE WHEN error_count > 0 THEN '🐛 Address critical errors first' END, '🔍 Consider refactoring problematic areas']
       ELSE list_concat(['✅ Project health is good - safe to proceed with development'],
         CASE WHEN task IS NOT NULL AND task <> '' THEN {D_TASKSPEC} ELSE [] END) END,
  [CASE WHEN is_dirty THEN '📝 Consider committing current progress' END]), lambda x: x IS NOT NULL)""",
                                               "st JOIN tk USING (project_id)")))
def rec_coding_steps(spark, sf_dir):
    return OV.coding_steps(_state_tasks(spark, sf_dir))


@query("rec_task", d_state(d_explode("project_id, task_id", """list_filter([
  CASE WHEN contains(lower(task), 'bug') OR contains(lower(task), 'fix') OR contains(lower(task), 'error') THEN '🐛 This is a bug fix - check current errors first' END,
  CASE WHEN (contains(lower(task), 'bug') OR contains(lower(task), 'fix') OR contains(lower(task), 'error')) AND error_count > 0 THEN '📋 Review active errors in the project' END,
  CASE WHEN (contains(lower(task), 'feature') OR contains(lower(task), 'add') OR contains(lower(task), 'implement')) AND health_score < 70 THEN '⚠️ Consider fixing existing issues before adding features'
       WHEN contains(lower(task), 'feature') OR contains(lower(task), 'add') OR contains(lower(task), 'implement') THEN '✅ Project health is good for new features' END,
  CASE WHEN contains(lower(task), 'refactor') OR contains(lower(task), 'improve') THEN '🔧 This is a refactoring task - ensure tests exist first' END,
  CASE WHEN contains(lower(task), 'refactor') OR contains(lower(task), 'improve') THEN '📸 Create snapshots before and after refactoring' END,
  CASE WHEN contains(lower(task), 'test') THEN '🧪 Focus on edge cases and error conditions' END,
  CASE WHEN contains(lower(task), 'test') THEN '📊 Check current test coverage if available' END], lambda x: x IS NOT NULL)""",
                                       "st JOIN tk USING (project_id)")))
def rec_task(spark, sf_dir):
    return OV.task_advice(_state_tasks(spark, sf_dir))


@query("inv_start", duckdb_with(["conversations"]) + """
SELECT conv_id AS task_id, 'Investigation: ' || substr(task, 1, 50) || '...' AS snapshot_name,
  'Starting investigation for: ' || task AS description, 'How should I approach: ' || task || '?' AS question,
  'high' AS priority, 'discovery' AS phase, CAST(1 AS BIGINT) AS version, 'initial' AS tags
FROM (SELECT conv_id, arg_min(text, turn) AS task FROM conversations WHERE role = 'user' GROUP BY conv_id) t""")
def inv_start(spark, sf_dir):
    return OV.investigation_start(conversation_tasks(spark, sf_dir))


@query("rec_file", d_state(f"""
SELECT f.file_id, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS advice FROM (
  SELECT f.file_id, list_filter([
    CASE WHEN coalesce(fe.n, 0) > 0 THEN printf('🐛 Fix %d error(s) in this file', fe.n) END,
    CASE WHEN {D_EXT.replace('rel_path', 'f.rel_path')} = '.go' THEN '🔍 Run ''go fmt'' and ''go vet'' for Go best practices'
         WHEN {D_EXT.replace('rel_path', 'f.rel_path')} IN ('.js', '.ts') THEN '🔍 Consider running ESLint or Prettier'
         WHEN {D_EXT.replace('rel_path', 'f.rel_path')} = '.py' THEN '🔍 Consider running Black or Flake8' END,
    CASE WHEN st.health_score < 80 THEN '🔧 Consider refactoring to improve code quality' END], lambda x: x IS NOT NULL) AS a
  FROM files f JOIN st USING (project_id)
  LEFT JOIN (SELECT 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, file, count(*) AS n FROM ({D_ACTIVE}) e GROUP BY ALL) fe
    ON fe.project_id = f.project_id AND fe.file = f.rel_path) f"""))
def rec_file(spark, sf_dir):
    """REC_FILE: advice per file from its errors (same project and path), extension and project health."""
    errs = active_errors(spark, sf_dir).withColumn("project_id", project_key(F.col("project_id")))
    fe = errs.groupBy("project_id", F.col("file").alias("rel_path")).agg(F.count(F.lit(1)).alias("file_errors"))
    f = (Views(spark, sf_dir)("files").select("file_id", "project_id", "rel_path")
         .join(project_state(spark, sf_dir).select("project_id", "health_score"), "project_id")
         .join(fe, ["project_id", "rel_path"], "left").fillna(0, ["file_errors"]))
    return OV.file_advice(f)


@query("flt_file_errors", duckdb_with(["files", "tool_output"]) + f"""
SELECT seq, 'src' || CAST(project_id % 20 AS VARCHAR) AS project_id, file, message,
  (SELECT count(*) > 0 FROM files WHERE contains(lower(rel_path), lower({sql_str(FILE_QUERY_PATH.split('/')[-1])}))) AS found_in_search
FROM ({D_ACTIVE}) a WHERE contains(coalesce(file, '') || ' ' || message || ' ' || source, {sql_str(FILE_QUERY_PATH)})""")
def flt_file_errors(spark, sf_dir):
    """FLT_FILE_ERRORS: errors that mention a path (file, message or source), with the name-search flag."""
    errs = active_errors(spark, sf_dir)
    text = F.concat_ws(" ", F.coalesce("file", F.lit("")), "message", "source")
    hits = errs.where(text.contains(FILE_QUERY_PATH))
    name = FILE_QUERY_PATH.split("/")[-1].lower()
    found = Views(spark, sf_dir)("files").where(F.lower("rel_path").contains(name)).select(F.count(F.lit(1)) > 0).scalar()
    return hits.select("seq", project_key(F.col("project_id")).alias("project_id"), "file", "message",
                       found.alias("found_in_search"))


D_DAILY = ("daily", f"""SELECT CAST(date_trunc('day', ts) AS DATE) AS day,
  CAST(greatest(0, 100 - 10 * count_if(severity = 'error') - 3 * count_if(severity = 'warning')) AS BIGINT) AS score,
  CAST(count(*) AS BIGINT) AS errors FROM ({D_CLASSIFIED}) c GROUP BY 1""")


def daily_quality(spark, sf_dir):
    """Analysis runs = days of process output: score per day from its error and warning lines."""
    c = D.classify_process_lines(Views(spark, sf_dir)("log_lines"))
    return c.groupBy(F.to_date("ts").alias("day")).agg(
        F.greatest(F.lit(0), 100 - 10 * F.count_if(F.col("severity") == "error")
                   - 3 * F.count_if(F.col("severity") == "warning")).cast("bigint").alias("score"),
        F.count(F.lit(1)).alias("errors"))


@query("agg_quality_trend", duckdb_with(["log_lines"], [D_DAILY]) + """
SELECT strftime(day, '%Y-%m-%d') AS day, score, CASE WHEN prev IS NULL THEN 'n/a' WHEN score > prev THEN 'improving'
  WHEN score < prev THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT *, lag(score) OVER (ORDER BY day) AS prev FROM daily) d""")
def agg_quality_trend(spark, sf_dir):
    """AGG_QUALITY_TREND: score per run (day) and its direction against the previous run.

    The window orders the per-day rows (one per calendar day), never raw events.
    """
    d = daily_quality(spark, sf_dir)
    prev = F.lag("score").over(Window.orderBy("day"))
    t = (F.when(prev.isNull(), "n/a").when(F.col("score") > prev, "improving")
         .when(F.col("score") < prev, "declining").otherwise("stable"))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "score", t.alias("trend"))


@query("agg_analysis_status", duckdb_with(["log_lines"], [D_DAILY]) + """
SELECT CAST(count(*) AS BIGINT) AS runs, strftime(max(day), '%Y-%m-%d') AS last_run, arg_max(score, day) AS latest_score,
  arg_max(errors, day) AS latest_errors FROM daily""")
def agg_analysis_status(spark, sf_dir):
    d = daily_quality(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("runs"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_run"),
                 F.max_by("score", "day").alias("latest_score"), F.max_by("errors", "day").alias("latest_errors"))
