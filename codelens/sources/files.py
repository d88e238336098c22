"""File-system sources: source trees, log files, captured tool output, snapshot store.

All of them are Spark jobs over a folder (``text`` and ``json`` readers, tasks
that list and read trees). Ignore rules are predicates on path
elements (see ``codelens.operators.project``), so they prune rows, not directories.
"""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.sinks.commits import Commits, Version
from codelens.sources.lines import RANGE_BYTES, numbered_lines
from codelens.sources.tree import Opener, qualified, read_files

_QUESTION = "struct<id:string,question:string,priority:string,status:string,created_at:timestamp,answered_at:timestamp,answer:string,source:string>"
_HYPOTHESIS = "struct<id:string,statement:string,confidence:double,evidence:array<string>,status:string,created_at:timestamp,tested_at:timestamp>"
_EVIDENCE = "struct<type:string,source:string,content:string,timestamp:timestamp>"
_FINDING = ("struct<id:string,title:string,description:string,impact:string,category:string,"
            f"evidence:array<{_EVIDENCE}>,created_at:timestamp,verified:boolean>")
_BLOCKER = ("struct<id:string,title:string,description:string,severity:string,type:string,status:string,"
            "created_at:timestamp,resolved_at:timestamp,resolution:string>")
_RECOMMENDATION = ("struct<id:string,type:string,title:string,description:string,confidence:double,priority:string,"
                   "status:string,created_at:timestamp,responded_at:timestamp,response:string>")
_DECISION = "struct<id:string,decision:string,rationale:string,impact:string,category:string,created_at:timestamp,outcome:string>"
_MESSAGE = "struct<id:string,source:string,type:string,content:string,timestamp:timestamp,references:array<string>>"
#: A snapshot as it is stored: one JSON object with the investigation, the collaboration and the project's state.
SNAPSHOT_SCHEMA = (
    "id string, name string, description string, created_at timestamp, updated_at timestamp, version int, "
    "parent_snapshot_id string, "
    "project_state struct<health_score:int,total_files:bigint,active_errors:bigint,languages:bigint>, "
    f"investigation struct<focus:string,goals:array<string>,current_phase:string,questions:array<{_QUESTION}>,"
    f"hypotheses:array<{_HYPOTHESIS}>,findings:array<{_FINDING}>,next_steps:array<string>,blockers:array<{_BLOCKER}>>, "
    "collaboration struct<session_id:string,interaction_count:int,last_interaction:timestamp,"
    f"ai_recommendations:array<{_RECOMMENDATION}>,human_decisions:array<{_DECISION}>,shared_context:map<string,string>,"
    f"communication_log:array<{_MESSAGE}>,tool_usage:map<string,int>>, "
    "metadata struct<tags:array<string>,project_path:string,git_commit:string,git_branch:string,"
    "environment:map<string,string>,size:bigint,checksum:string,related_snapshots:array<string>,export_formats:array<string>>"
)


def read_tree(spark: SparkSession, root: str, project_id: str | None = None, open_root: Opener = pafs.FileSystem.from_uri) -> DataFrame:
    """SRC_FILES: one row per file of a tree: rel_path, size, mod_time, content (text), is_text.

    ``root`` is a path or URI on any file system that ``open_root`` opens (see
    ``codelens.sources.tree``); hidden and empty files have rows, what cannot be
    read has none. Bytes that are no UTF-8 are replaced in content, and is_text
    tells such files and those with zero bytes.
    """
    found = read_files(spark, root, open_root)
    return found.select(
        F.lit(project_id).alias("project_id"),
        F.xxhash64(F.lit(root.rstrip("/")), "path").alias("file_id"),
        F.col("path").alias("rel_path"), "size", "mod_time", "content", "is_text",
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """SRC_LINES: (file, line_no, line) from whole-file content, line_no = position + 1."""
    return files.select("file_id", F.posexplode(F.split(F.col("content"), "\n")).alias("pos", "line")) \
        .select("file_id", (F.col("pos") + 1).alias("line_no"), "line")


# FIXED VALUES: log globs (non-recursive) of the core watcher and of the Python and JavaScript plug-ins
LOG_GLOBS = ["*.log", "logs/*.log", "log/*.log"]
PY_LOG_GLOBS = LOG_GLOBS + ["django.log", "app.log", "error.log"]
JS_LOG_GLOBS = LOG_GLOBS + [".next/*.log", "npm-debug.log*", "yarn-debug.log*", "yarn-error.log*"]


def read_logs(spark: SparkSession, root: str, globs=LOG_GLOBS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC_LOGS: log files by non-recursive globs, each file once, as numbered lines; empty files have none."""
    return numbered_lines(spark, _existing(spark, [f"{root.rstrip('/')}/{g}" for g in globs]), range_bytes)


def _existing(spark: SparkSession, globs: list[str]) -> list[tuple[str, int]]:
    """The files (URI, size) that non-recursive globs name, each once, found through the globs' own file system."""
    found: dict[str, int] = {}
    for g in globs:
        path = spark._jvm.org.apache.hadoop.fs.Path(g)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
            if status.isFile() and status.getLen() > 0:
                found[qualified(spark, status.getPath().toString())] = status.getLen()
    return sorted(found.items())


def read_tool_output(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC_TOOL_OUTPUT: captured stdout+stderr files, one row per line, with the file as the run."""
    lines = numbered_lines(spark, _existing(spark, [f"{folder.rstrip('/')}/*"]), range_bytes)
    return lines.select(F.col("file").alias("run"), F.col("line_no").alias("seq"), "line")


_STATE = f"{SNAPSHOT_SCHEMA}, saved_at long, deleted boolean"


def committed_states(spark: SparkSession, commits: Commits, version: Version) -> DataFrame:
    """All states that a version of the store is made of, with the number of their commit (column commit)."""
    if not version.live:
        return spark.createDataFrame([], _STATE).withColumn("commit", F.lit(0).cast("long"))
    reader = spark.read.schema(_STATE).option("mode", "DROPMALFORMED")
    numbers = {name: n for n, name in version.live}  # a commit that was tried again has two, the last one counts
    states = reader.json([commits.path_of(name) for name in numbers]).select("*", "_metadata.file_path")
    number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return states.withColumn("commit", number[F.element_at(F.split("file_path", "/"), -2)].cast("long")).drop("file_path")


def last_states(states: DataFrame) -> DataFrame:
    """Each id's state of the highest commit; within one commit the one updated last, then by its checksum."""
    columns = [c for c in states.columns if c not in ("id", "commit")]
    order = F.struct("commit", F.coalesce("saved_at", F.unix_micros("updated_at"), F.lit(0)), F.col("metadata.checksum"))
    last = states.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("s"))
    return last.select("id", *[f"s.{c}" for c in columns])


def read_snapshots(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """SRC_SNAP_STORE: the newest state of every snapshot in the store; unreadable files and lines are skipped.

    Reads one version of the store's log (the newest, or the one of the number
    ``version`` while its files are kept), and files beside it: single
    ``snapshot-*.json`` documents and lines of ``part-*.json``, whose states are
    older than all commits. Of the states of one id the last one counts, and an
    id that was deleted last is gone.
    """
    commits = Commits(spark, folder)
    reader = spark.read.schema(_STATE).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED")
    lines = reader.option("pathGlobFilter", "part-*.json").option("multiLine", "false").json(folder)
    single = reader.option("pathGlobFilter", "snapshot-*.json").option("multiLine", "true").json(folder)
    beside = lines.unionByName(single).withColumn("commit", F.lit(0).cast("long"))
    states = beside.unionByName(committed_states(spark, commits, commits.version(version))).where("id IS NOT NULL")
    return last_states(states).where("NOT coalesce(deleted, false)").drop("saved_at", "deleted")


def read_process_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet",
                        max_files_per_trigger: int = 1000) -> DataFrame:
    """SRC_PROC_STREAM over finished files that arrive in a folder; ``codelens.sources.growing`` follows files that grow."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", str(max_files_per_trigger)).load(folder)
