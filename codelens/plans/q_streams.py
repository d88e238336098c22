"""Batch twins of the polling watchers: file changes, git status, processes, process requests and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.operators import ops as O
from codelens.operators import process as P
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.registry import Views, query, sql_list, sql_str

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

D_CHANGES = ("changes", """SELECT seq, path, observed_at, mtime,
  CASE WHEN prev_seq IS NULL THEN 'created' WHEN mtime > prev_mtime THEN 'modified' END AS change_type FROM (
  SELECT *, lag(seq) OVER w AS prev_seq, lag(mtime) OVER w AS prev_mtime FROM file_observations WINDOW w AS (PARTITION BY path ORDER BY seq)) s""")


@query("win_changes", duckdb_with(["file_observations"], [D_CHANGES]) + f"""
SELECT seq, path, change_type, {duck.ts_text('mtime')} AS mtime FROM changes WHERE change_type IS NOT NULL""")
def win_changes(spark, sf_dir):
    obs = Views(spark, sf_dir)("file_observations")
    return P.file_changes(obs).select("seq", "path", "change_type", F.date_format("mtime", TS_FMT).alias("mtime"))


@query("str_recent", duckdb_with(["file_observations"], [D_CHANGES]) + f"""
SELECT seq, path, change_type, {duck.ts_text('observed_at')} AS observed_at, CAST(r AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY observed_at DESC, seq DESC) AS r FROM changes WHERE change_type IS NOT NULL) s
WHERE r <= 100 AND observed_at > (SELECT max(observed_at) FROM changes WHERE change_type IS NOT NULL) - INTERVAL 10 MINUTES""")
def str_recent(spark, sf_dir):
    """STR_RECENT (batch): each workspace's newest 100 changes, then those of the last 10 minutes before the newest change."""
    ch = P.file_changes(Views(spark, sf_dir)("file_observations"))
    r = P.recent_changes(ch, as_of=ch.select(F.max("observed_at")).scalar())
    return r.select("seq", "path", "change_type", F.date_format("observed_at", TS_FMT).alias("observed_at"), "rank")


@query("win_retain_changes", duckdb_with(["file_observations"], [D_CHANGES]) + """
SELECT seq, path, change_type, CAST(r AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY seq DESC) AS r FROM changes
  WHERE change_type IS NOT NULL) s WHERE r <= 100""")
def win_retain_changes(spark, sf_dir):
    """WIN_RETAIN for changes: the last 100 changes of each workspace are kept (partial top-k)."""
    ch = P.file_changes(Views(spark, sf_dir)("file_observations")).withColumn("project", P.change_project(F.col("path")))
    return P.top_k(ch, ["project"], [F.col("seq").desc()], C.MAX_CHANGES).select("seq", "path", "change_type", "rank")


D_GIT = ("git", """SELECT seq, project_id, substr(line, 4) AS file,
  CASE WHEN substr(line, 1, 1) NOT IN (' ', '?') THEN 'staged' WHEN substr(line, 2, 1) <> ' ' THEN 'modified'
       WHEN substr(line, 1, 2) = '??' THEN 'untracked' END AS category
FROM git_status_lines WHERE length(line) >= 3""")


@query("git_status_files", duckdb_with(["git_status_lines"], [D_GIT]) + """
SELECT seq, project_id, file, category FROM git WHERE category IS NOT NULL""")
def git_status_files(spark, sf_dir):
    return O.git_status_files(Views(spark, sf_dir)("git_status_lines")).select("seq", "project_id", "file", "category")


@query("agg_git_status", duckdb_with(["git_status_lines"], [D_GIT]) + """
SELECT project_id, CAST(count_if(category = 'staged') AS BIGINT) AS staged,
  CAST(count_if(category = 'modified') AS BIGINT) AS modified, CAST(count_if(category = 'untracked') AS BIGINT) AS untracked,
  count_if(category = 'modified') > 0 OR count_if(category = 'untracked') > 0 AS is_dirty
FROM git WHERE category IS NOT NULL GROUP BY project_id""")
def agg_git_status(spark, sf_dir):
    return O.git_status_summary(O.git_status_files(Views(spark, sf_dir)("git_status_lines")))


@query("agg_processes", duckdb_with(["ps_lines"]) + f"""
SELECT seq, TRY_CAST(f[2] AS BIGINT) AS pid, f[11] AS name, array_to_string(f[11:], ' ') AS command,
  contains(line, {sql_str(O.WORKSPACE)}) AS is_project_related
FROM (SELECT *, string_split_regex({duck.trim('line')}, '{duck.WS}+') AS f FROM ps_lines
      WHERE contains(line, 'node') OR contains(line, 'go') OR contains(line, 'python') OR contains(line, {sql_str(O.WORKSPACE)})) s
WHERE len(f) >= 11 AND TRY_CAST(f[2] AS BIGINT) IS NOT NULL""")
def agg_processes(spark, sf_dir):
    return O.processes(Views(spark, sf_dir)("ps_lines")).select("seq", "pid", "name", "command", "is_project_related")


@query("flt_request", duckdb_with(["process_requests"]) + f"""
SELECT req_id, command, CASE WHEN command IS NULL OR command = '' THEN 'command cannot be empty'
  WHEN length(command) > {C.MAX_COMMAND_LENGTH} THEN 'command too long'
  WHEN command NOT IN ({sql_list(C.ALLOWED_COMMANDS)}) THEN 'command not allowed: ' || command END AS reason,
  NOT (command IS NULL OR command = '' OR length(command) > {C.MAX_COMMAND_LENGTH} OR command NOT IN ({sql_list(C.ALLOWED_COMMANDS)})) AS accepted
FROM process_requests""")
def flt_request(spark, sf_dir):
    return O.request_validation(Views(spark, sf_dir)("process_requests")).select("req_id", "command", "reason", "accepted")


D_DEV = """CASE WHEN command = 'npm' AND len(string_split(coalesce(args, ''), ' ')) > 1 AND string_split(coalesce(args, ''), ' ')[2] = 'dev'
  THEN 'npm/next/vite' WHEN command = 'npm' THEN 'unknown' WHEN command = 'go' THEN 'go' WHEN command = 'python' THEN 'python'
  ELSE 'unknown' END"""


D_STARTED = ("started", """SELECT pid, arg_max(event, seq) AS last, arg_max(ts, seq) FILTER (WHERE event = 'started') AS start_time
FROM process_events WHERE event IN ('started', 'exited') GROUP BY pid""")


@query("agg_dev_servers", duckdb_with(["process_requests", "process_events"], [D_STARTED]) + f"""
SELECT server_type || '_' || pid AS name, server_type, pid, command, args, CASE WHEN last = 'started' THEN 'running' ELSE 'stopped' END AS status,
  {duck.ts_text('start_time')} AS start_time,
  CAST(epoch(date_trunc('second', (SELECT max(ts) FROM process_events))) - epoch(date_trunc('second', start_time)) AS BIGINT) AS uptime_seconds
FROM (SELECT req_id AS pid, command, args, {D_DEV} AS server_type FROM process_requests WHERE command IN ({sql_list(C.ALLOWED_COMMANDS)})) r
JOIN started USING (pid) WHERE start_time IS NOT NULL""")
def agg_dev_servers(spark, sf_dir):
    """Monitored (accepted and started) processes with type, status, start time and uptime as of the newest event."""
    v = Views(spark, sf_dir)
    requests = v("process_requests").select(F.col("req_id").alias("pid"), "command", "args")
    events = v("process_events")
    out = O.dev_servers(requests, events, events.select(F.max("ts")).scalar())
    return out.withColumn("start_time", F.date_format("start_time", TS_FMT))


@query("agg_dev_server_types", duckdb_with(["process_requests"]) + f"""
SELECT server_type, CAST(count(*) AS BIGINT) AS servers FROM (SELECT {D_DEV} AS server_type FROM process_requests
  WHERE command IN ({sql_list(C.ALLOWED_COMMANDS)})) s GROUP BY server_type""")
def agg_dev_server_types(spark, sf_dir):
    """Accepted process requests by dev-server type."""
    r = O.request_validation(Views(spark, sf_dir)("process_requests")).where("accepted")
    return (r.select(O.dev_server_type(F.col("command"), F.col("args")).alias("server_type"))
            .groupBy("server_type").agg(F.count(F.lit(1)).alias("servers")))


@query("agg_process_metrics", duckdb_with(["process_events"]) + """
SELECT CAST(count_if(event = 'start_attempt') AS BIGINT) AS process_start_attempts,
  CAST(count_if(event = 'start_failure') AS BIGINT) AS process_start_failures,
  CAST(count_if(event = 'started') - count_if(event = 'exited') AS BIGINT) AS active_processes,
  CAST(count_if(event = 'error_line') AS BIGINT) AS total_errors FROM process_events""")
def agg_process_metrics(spark, sf_dir):
    return O.process_metrics(Views(spark, sf_dir)("process_events"))


@query("str_counters", duckdb_with(["process_events"]) + """
SELECT pid, CAST(count_if(event = 'error_line') AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS events
FROM process_events GROUP BY pid""")
def str_counters(spark, sf_dir):
    """STR_COUNTERS (batch twin): running error and event counters per process."""
    e = Views(spark, sf_dir)("process_events")
    return e.groupBy("pid").agg(F.count_if(F.col("event") == "error_line").cast("bigint").alias("errors"),
                                F.count(F.lit(1)).alias("events"))
