"""Captured command output of the workspace: git status, process lists, process requests and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.text import fields

WORKSPACE = "/work/proj"


def git_status_files(lines: DataFrame) -> DataFrame:
    """AGG_GIT_STATUS rows: porcelain ``XY name`` -> staged / modified / untracked, in the source's case order.

    X not blank and not '?' -> staged; else Y not blank -> modified; else '??' -> untracked
    (so '??' lands in modified, as the source's order makes it; lines shorter than 3 are skipped).
    """
    ln = F.col("line")
    x, y, code = F.substring(ln, 1, 1), F.substring(ln, 2, 1), F.substring(ln, 1, 2)
    cat = (F.when((x != " ") & (x != "?"), "staged").when(y != " ", "modified")
           .when(code == "??", "untracked"))
    return (lines.where(F.length(ln) >= 3)
            .select("*", F.substring(ln, 4, 1 << 30).alias("file"), cat.alias("category"))
            .where(F.col("category").isNotNull()))


def git_status_summary(files: DataFrame, keys=("project_id",)) -> DataFrame:
    """Per project: counts per category and the dirty flag (modified or untracked; staged does not count)."""
    c = F.col("category")
    return (files.groupBy(*keys).agg(
        F.count_if(c == "staged").cast("bigint").alias("staged"),
        F.count_if(c == "modified").cast("bigint").alias("modified"),
        F.count_if(c == "untracked").cast("bigint").alias("untracked"))
        .withColumn("is_dirty", (F.col("modified") > 0) | (F.col("untracked") > 0)))


def processes(lines: DataFrame, workspace: str = WORKSPACE) -> DataFrame:
    """AGG_PROCESSES: ``ps aux`` lines naming node/go/python/the workspace, >= 11 fields, numeric pid."""
    ln = F.col("line")
    f = fields(ln)
    keep = ln.contains("node") | ln.contains("go") | ln.contains("python") | ln.contains(workspace)
    return (lines.where(keep).withColumn("_f", f).where(F.size("_f") >= 11)
            .withColumn("pid", F.element_at("_f", 2).try_cast("bigint")).where(F.col("pid").isNotNull())
            .select("*", F.element_at("_f", 11).alias("name"),
                    F.array_join(F.slice("_f", 11, 1 << 20), " ").alias("command"),
                    ln.contains(workspace).alias("is_project_related"))
            .drop("_f"))


def request_validation(requests: DataFrame) -> DataFrame:
    """FLT_REQUEST: reason a start request is refused (NULL = accepted): empty, too long, not allowed."""
    cmd = F.col("command")
    reason = (F.when(cmd.isNull() | (cmd == ""), F.lit("command cannot be empty"))
              .when(F.length(cmd) > C.MAX_COMMAND_LENGTH, F.lit("command too long"))
              .when(~cmd.isin(C.ALLOWED_COMMANDS), F.concat(F.lit("command not allowed: "), cmd)))
    return requests.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def dev_server_type(command: Column, args: Column) -> Column:
    """AGG_DEV_SERVERS: npm with second argument 'dev', go, python, else unknown."""
    a = F.split(F.coalesce(args, F.lit("")), " ")
    return (F.when((command == "npm") & (F.size(a) > 1) & (F.element_at(a, 2) == "dev"), "npm/next/vite")
            .when(command == "npm", "unknown")
            .when(command == "go", "go").when(command == "python", "python").otherwise("unknown"))


def dev_server_patterns(servers: DataFrame, pid: str = "pid", kind: str = "kind") -> DataFrame:
    """UDX_PATTERNS defaults: (pid, pattern) for each process of a known dev-server type (npm, go, python, next, vite)."""
    sets = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in C.DEV_SERVER_PATTERNS.items() for x in pair])
    return servers.select(F.col(pid).alias("pid"), F.explode(F.try_element_at(sets, F.col(kind))).alias("pattern"))


def dev_servers(requests: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """AGG_DEV_SERVERS: a row for each accepted process that was started: name, type, status, start time, uptime in seconds.

    requests: (pid, command, args); events: (pid, seq, ts, event). The start is
    the last one; a process whose last start or exit is an exit is stopped.
    """
    event = F.col("event")
    last = events.where(event.isin("started", "exited")).groupBy("pid").agg(
        F.max_by("event", "seq").alias("last"), F.max_by(F.when(event == "started", F.col("ts")), F.when(event == "started", F.col("seq"))).alias("start_time"))
    accepted = request_validation(requests).where("accepted").select("pid", "command", "args", dev_server_type(F.col("command"), F.col("args")).alias("server_type"))
    uptime = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("start_time").cast("timestamp"))
    return accepted.join(last.where("start_time IS NOT NULL"), "pid").select(
        F.concat_ws("_", "server_type", F.col("pid").cast("string")).alias("name"), "server_type", "pid", "command", "args",
        F.when(F.col("last") == "started", "running").otherwise("stopped").alias("status"), "start_time", uptime.alias("uptime_seconds"))


def process_metrics(events: DataFrame, keys=()) -> DataFrame:
    """AGG_PROCESS_METRICS: start attempts, failures, active (started - exited), error lines."""
    e = F.col("event")
    return events.groupBy(*keys).agg(
        F.count_if(e == "start_attempt").cast("bigint").alias("process_start_attempts"),
        F.count_if(e == "start_failure").cast("bigint").alias("process_start_failures"),
        (F.count_if(e == "started") - F.count_if(e == "exited")).cast("bigint").alias("active_processes"),
        F.count_if(e == "error_line").cast("bigint").alias("total_errors"))
