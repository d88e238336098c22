"""Snapshot sinks: the store, and JSON / Markdown / HTML exports.

A stored snapshot is one nested row (``sources.files.SNAPSHOT_SCHEMA``), so an
export is an expression over that row: no shuffle, and no document is put
together from rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.sinks.commits import COMPACT_AT, KEEP_MS, Commits
from codelens.sources.files import committed_states, last_states

TIME = "yyyy-MM-dd HH:mm:ss"
_JSON = {"timestampFormat": TIME, "timestampNTZFormat": TIME}


def content_json() -> Column:
    """The snapshot's content as JSON (its checksum covers this text): no time of saving, size or checksum."""
    metadata = F.col("metadata").dropFields("size", "checksum")
    return F.to_json(F.struct(
        "id", "name", "description", "created_at", "version", "parent_snapshot_id", "project_state", "investigation",
        "collaboration", metadata.alias("metadata")), _JSON)


def with_metadata(snapshots: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """SNK_SNAP_SAVE / SNP_CHECKSUM: size and SHA-256 of the content in the metadata, and the time of saving."""
    body = content_json()
    metadata = F.col("metadata").withField("size", F.octet_length(body).cast("bigint")).withField("checksum", F.sha2(body, 256))
    return snapshots.withColumns({"metadata": metadata, "updated_at": updated_at if updated_at is not None else F.current_timestamp()})


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def save_snapshots(snapshots: DataFrame, folder: str, updated_at: Column | None = None, compact_at: int = COMPACT_AT) -> int:
    """SNK_SNAP_SAVE: store the snapshots; one whose id is stored already gets its new state, all others stay.

    One save is one commit of the folder's log (``codelens.sinks.commits``) and
    gives its number: states count in the order of commits, several writers may
    save at a time, and a save that fails leaves nothing that readers see. A
    save that is repeated changes nothing but the time of saving. Of rows with
    one id in one save the last updated counts. Every ``compact_at`` commits
    the writer folds the store.
    """
    commits = Commits(snapshots.sparkSession, folder)
    number = commits.commit(with_metadata(snapshots, updated_at), _write)
    if len(commits.version().live) >= compact_at:
        compact_store(snapshots.sparkSession, folder)
    return number


def delete_from_store(ids: DataFrame, folder: str) -> int:
    """SNP_DELETE on the store: the ids (column id) are gone from the next read on; gives the commit's number."""
    gone = ids.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("deleted"))
    return Commits(ids.sparkSession, folder).commit(gone, _write)


def compact_store(spark: SparkSession, folder: str, keep_ms: int = KEEP_MS) -> int:
    """Fold all commits of the store into one with each id's last state (or the mark that it is deleted).

    Writers and readers go on meanwhile: what is saved after the version that
    is folded stays live. Files that earlier compactions replaced go once they
    are older than ``keep_ms``. Gives the number of the compaction.
    """
    commits = Commits(spark, folder)
    version = commits.version()
    if len(version.live) > 1:
        number = commits.commit(last_states(committed_states(spark, commits, version)), _write, through=version.live[-1][0])
    else:
        number = version.number
    commits.remove_replaced(keep_ms)
    return number


def export_json(snapshots: DataFrame, project_state: bool = True, collaboration: bool = True) -> DataFrame:
    """SNK_EXPORT_JSON: (id, json) with the investigation and metadata, and on request the project's state and the collaboration."""
    parts = [F.col("id").alias("snapshot_id"), "name", "description", "created_at", "updated_at", "version", "investigation", "metadata"]
    parts += ["project_state"] * project_state + ["collaboration"] * collaboration
    return snapshots.select("id", F.to_json(F.struct(*parts), _JSON).alias("json"))


def _text(*parts: str | Column) -> Column:
    """The parts as one string; a missing value is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _minute(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def _section(title: str, entries: Column, one, end: str = "") -> Column:
    """A section of the entries, or nothing where there are none."""
    body = F.array_join(F.transform(entries, one), "")
    return F.when(F.size(entries) > 0, F.concat(F.lit(title), body, F.lit(end))).otherwise(F.lit(""))


def _numbered(title: str, entries: Column, end: str) -> Column:
    return _section(title, entries, lambda x, i: _text(i + 1, ". ", x, "\n"), end)


def _icon(status: Column, icons: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for value, icon in icons.items():
        out = F.when(status == value, F.lit(icon)).otherwise(out)
    return out


def _question(q: Column) -> Column:
    answer = F.when(F.coalesce(q["answer"], F.lit("")) != "", _text("- **Answer:** ", q["answer"], "\n"))
    # FIXED VALUES: status icons
    icon = _icon(q["status"], {"answered": "✅", "investigating": "🔍"}, "🔓")
    return _text("### ", icon, " ", q["question"], "\n- **Priority:** ", q["priority"], "\n- **Source:** ", q["source"],
                 "\n- **Created:** ", _minute(q["created_at"]), "\n", answer, "\n")


def _hypothesis(h: Column) -> Column:
    evidence = _section("- **Evidence:**\n", h["evidence"], lambda e: _text("  - ", e, "\n"))
    # FIXED VALUES: status icons
    icon = _icon(h["status"], {"confirmed": "✅", "refuted": "❌"}, "🔬")
    return _text("### ", icon, " ", h["statement"], "\n- **Confidence:** ", F.format_string("%.2f", h["confidence"]), "\n- **Status:** ", h["status"],
                 "\n- **Created:** ", _minute(h["created_at"]), "\n", evidence, "\n")


def _finding(f: Column) -> Column:
    # FIXED VALUES: status icons
    icon = F.when(f["verified"], F.lit("✅")).otherwise(F.lit("⏳"))
    return _text("### ", icon, " ", f["title"], "\n**Description:** ", f["description"], "\n\n- **Impact:** ", f["impact"],
                 "\n- **Category:** ", f["category"], "\n- **Created:** ", _minute(f["created_at"]), "\n\n")


def _blocker(b: Column) -> Column:
    resolution = F.when(F.coalesce(b["resolution"], F.lit("")) != "", _text("- **Resolution:** ", b["resolution"], "\n"))
    # FIXED VALUES: status icons
    icon = _icon(b["status"], {"resolved": "✅", "investigating": "🔍"}, "🔴")
    return _text("### ", icon, " ", b["title"], "\n**Description:** ", b["description"], "\n\n- **Severity:** ", b["severity"],
                 "\n- **Type:** ", b["type"], "\n- **Created:** ", _minute(b["created_at"]), "\n", resolution, "\n")


def markdown(generated_at: Column, project_state: bool = True, collaboration: bool = True) -> Column:
    """SNK_EXPORT_MD: the Markdown text of a snapshot row."""
    inv, col, state = F.col("investigation"), F.col("collaboration"), F.col("project_state")
    out = [
        _text("# Investigation Snapshot: ", F.col("name"), "\n\n**Created:** ", F.date_format("created_at", TIME), "  \n**Updated:** ",
              F.date_format("updated_at", TIME), "  \n**Version:** ", F.col("version"), "  \n**Description:** ", F.col("description"), "\n\n"),
        _text("## 🔍 Investigation Context\n\n**Focus:** ", inv["focus"], "  \n**Current Phase:** ", inv["current_phase"], "  \n"),
        _numbered("\n### Goals\n", inv["goals"], ""),
        _section("\n## ❓ Questions\n\n", inv["questions"], _question),
        _section("\n## 💡 Hypotheses\n\n", inv["hypotheses"], _hypothesis),
        _section("\n## 🎯 Findings\n\n", inv["findings"], _finding),
        _section("\n## 🚧 Blockers\n\n", inv["blockers"], _blocker),
        _numbered("\n## 📋 Next Steps\n\n", inv["next_steps"], "\n"),
    ]
    if collaboration:
        count = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
        out.append(_text("\n## 🤝 Collaboration Summary\n\n- **Session ID:** ", col["session_id"], "\n- **Interactions:** ", col["interaction_count"],
                         "\n- **Last Interaction:** ", _minute(col["last_interaction"]), "\n- **AI Recommendations:** ", count(col["ai_recommendations"]),
                         "\n- **Human Decisions:** ", count(col["human_decisions"]), "\n"))
    if project_state:
        out.append(F.when(state.isNotNull(), _text(
            "\n## 📊 Project State\n\n- **Health Score:** ", state["health_score"], "/100\n- **Total Files:** ", state["total_files"],
            "\n- **Active Errors:** ", state["active_errors"], "\n- **Languages:** ", state["languages"], "\n")).otherwise(F.lit("")))
    out.append(_text("\n---\n*Generated on ", F.date_format(generated_at, TIME), "*\n"))
    return F.concat(*out)


def export_markdown(snapshots: DataFrame, generated_at: Column | None = None, project_state: bool = True, collaboration: bool = True) -> DataFrame:
    """SNK_EXPORT_MD: (id, markdown)."""
    when = generated_at if generated_at is not None else F.current_timestamp()
    return snapshots.select("id", markdown(when, project_state, collaboration).alias("markdown"))


_HEAD = ('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n'
         '<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>Investigation Snapshot: ')
_MIDDLE = "</title>\n</head>\n<body>\n<pre>\n"
_TAIL = "</pre>\n</body>\n</html>\n"


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def export_html(snapshots: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """SNK_EXPORT_HTML: (id, html): the Markdown text, escaped, in a page of its own."""
    when = generated_at if generated_at is not None else F.current_timestamp()
    return snapshots.select("id", F.concat(
        F.lit(_HEAD), escape_html(F.coalesce("name", F.lit(""))), F.lit(_MIDDLE), escape_html(markdown(when)), F.lit(_TAIL)).alias("html"))


def write_documents(documents: DataFrame, text: str, folder: str) -> None:
    """Write (id, text) documents as text files, one folder for each id."""
    documents.select("id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("id").text(folder)
