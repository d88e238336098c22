"""Project state, summaries and advice.

``project_state`` joins small per-project aggregates (one row per project
each) on ``project_id``; the advice operators are ``filter(array(when ...))``
projections of that state, exploded with their position.

FIXED VALUES: every advice text and threshold in this module is the source
tool's text and threshold, kept verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def advice(df: DataFrame, keys, items: list[Column], col: str = "advice") -> DataFrame:
    """Rows (keys..., pos, advice) for the non-null items, in order."""
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return df.select(*keys, F.posexplode(arr).alias("pos", col)).withColumn("pos", F.col("pos").cast("bigint"))


def health_advice(s: DataFrame) -> DataFrame:
    """REC_HEALTH: health 50/80, errors 10/0, dirty tree, project type tools."""
    h, e, t = F.col("health_score"), F.col("error_count"), F.col("project_type")
    return advice(s, ["project_id"], [
        F.when(h < 50, F.lit("🚨 Project health is critical - focus on fixing errors first"))
        .when(h < 80, F.lit("⚠️ Project health needs attention - consider refactoring"))
        .otherwise(F.lit("✅ Project health is good - safe to add new features")),
        F.when(e > 10, F.lit("🐛 High error count - prioritize bug fixes over new features"))
        .when(e > 0, F.format_string("🔧 Fix %d active error(s) before proceeding", e)),
        F.when(F.col("is_dirty"), F.lit("💾 Consider committing current changes")),
        F.when(t == "go", F.lit("🔍 Use 'go fmt', 'go vet', and 'go mod tidy' for Go best practices"))
        .when(t.isin("javascript", "typescript"), F.lit("🔍 Consider using ESLint, Prettier, and TypeScript checks"))
        .when(t == "python", F.lit("🔍 Consider using Black, Flake8, and mypy for Python")),
    ])


def next_action_items(s: DataFrame) -> list[Column]:
    e, h = F.col("error_count"), F.col("health_score")
    return [
        F.when(e > 0, F.format_string("🐛 Fix %d active errors", e)),
        F.when(F.col("is_dirty"), F.lit("💾 Commit pending changes")),
        F.when(h < 90, F.format_string("🔧 Improve code quality (current score: %d/100)", h)),
        F.when(F.col("dependency_count") > 0, F.lit("📦 Review dependencies for updates")),
    ]


def next_actions(s: DataFrame) -> DataFrame:
    """REC_NEXT_ACTIONS: errors, dirty tree, health < 90, dependencies; a default when none applies."""
    items = F.filter(F.array(*next_action_items(s)), lambda x: x.isNotNull())
    items = F.when(F.size(items) == 0, F.array(F.lit("✅ Project looks good! Consider adding tests or documentation"))) \
        .otherwise(items)
    return s.select("project_id", F.posexplode(items).alias("pos", "advice")).withColumn("pos", F.col("pos").cast("bigint"))


def _task_specific(task: Column) -> list[Column]:
    t = F.lower(task)
    test = t.contains("test")
    api = ~test & (t.contains("api") | t.contains("endpoint"))
    db = ~test & ~api & (t.contains("database") | t.contains("db"))
    ui = ~test & ~api & ~db & (t.contains("ui") | t.contains("frontend"))
    return [
        F.when(test, F.lit("🧪 Focus on edge cases and error conditions")),
        F.when(test, F.lit("📊 Ensure good test coverage")),
        F.when(api, F.lit("🔒 Implement proper authentication and validation")),
        F.when(api, F.lit("📝 Document API endpoints")),
        F.when(db, F.lit("🛡️ Use parameterized queries to prevent SQL injection")),
        F.when(db, F.lit("🚀 Consider database indexes for performance")),
        F.when(ui, F.lit("♿ Ensure accessibility compliance")),
        F.when(ui, F.lit("📱 Test responsive design")),
    ]


def coding_steps(s: DataFrame) -> DataFrame:
    """REC_CODING_STEPS: advice by health 30/70, errors, dirty tree and the project's task words."""
    h, e = F.col("health_score"), F.col("error_count")
    actions = F.filter(F.array(*next_action_items(s)), lambda x: x.isNotNull())
    first2 = F.transform(F.slice(actions, 1, 2), lambda a: F.concat(F.lit("🔧 "), a))
    crit = h < 30
    mod = ~crit & (h < 70)
    good = ~crit & ~mod
    base = F.array(
        F.when(crit, F.lit("🆘 Critical: Project health is very low - focus on error resolution")),
        F.when(mod, F.lit("⚠️ Moderate issues detected - balance fixes with development")),
        F.when(mod & (e > 0), F.lit("🐛 Address critical errors first")),
        F.when(mod, F.lit("🔍 Consider refactoring problematic areas")),
        F.when(good, F.lit("✅ Project health is good - safe to proceed with development")),
    )
    task = F.array(*[F.when(good & F.col("task").isNotNull() & (F.col("task") != ""), x)
                     for x in _task_specific(F.col("task"))])
    tail = F.array(F.when(F.col("is_dirty"), F.lit("📝 Consider committing current progress")))
    items = F.concat(F.slice(base, 1, 1), F.when(crit, first2).otherwise(F.array().cast("array<string>")),
                     F.slice(base, 2, 4), task, tail)
    return (s.select("project_id", "task_id", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("pos", "advice"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def task_advice(s: DataFrame) -> DataFrame:
    """REC_TASK: advice from the task's words (bug/fix/error, feature/add/implement, refactor/improve, test)."""
    t = F.lower(F.col("task"))
    bug = t.contains("bug") | t.contains("fix") | t.contains("error")
    feat = t.contains("feature") | t.contains("add") | t.contains("implement")
    ref = t.contains("refactor") | t.contains("improve")
    test = t.contains("test")
    return advice(s, ["project_id", "task_id"], [
        F.when(bug, F.lit("🐛 This is a bug fix - check current errors first")),
        F.when(bug & (F.col("error_count") > 0), F.lit("📋 Review active errors in the project")),
        F.when(feat & (F.col("health_score") < 70), F.lit("⚠️ Consider fixing existing issues before adding features"))
        .when(feat, F.lit("✅ Project health is good for new features")),
        F.when(ref, F.lit("🔧 This is a refactoring task - ensure tests exist first")),
        F.when(ref, F.lit("📸 Create snapshots before and after refactoring")),
        F.when(test, F.lit("🧪 Focus on edge cases and error conditions")),
        F.when(test, F.lit("📊 Check current test coverage if available")),
    ])


def file_advice(files_with_errors: DataFrame) -> DataFrame:
    """REC_FILE: per file: its error count, a tool hint by extension, refactoring when health < 80."""
    ext = F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1))
    return advice(files_with_errors, ["file_id"], [
        F.when(F.col("file_errors") > 0, F.format_string("🐛 Fix %d error(s) in this file", F.col("file_errors"))),
        F.when(ext == ".go", F.lit("🔍 Run 'go fmt' and 'go vet' for Go best practices"))
        .when(ext.isin(".js", ".ts"), F.lit("🔍 Consider running ESLint or Prettier"))
        .when(ext == ".py", F.lit("🔍 Consider running Black or Flake8")),
        F.when(F.col("health_score") < 80, F.lit("🔧 Consider refactoring to improve code quality")),
    ])


def quality_summary(s: DataFrame) -> DataFrame:
    """AGG_QUALITY_SUMMARY: score, critical (type error) and warning counts, debt, todos, advice."""
    recs = F.filter(F.array(
        F.when(F.col("errors_e") > 0, F.lit("Fix critical errors before proceeding with new features")),
        F.when(F.col("health_score") < 80, F.lit("Consider refactoring to improve code quality")),
        F.when(F.col("todo_count") > 20, F.lit("Address TODO items to reduce technical debt"))), lambda x: x.isNotNull())
    return s.select("project_id", F.col("health_score").alias("overall_score"), F.col("errors_e").alias("critical_issues"),
                    F.col("warning_count").alias("warnings"), "technical_debt", "todo_count",
                    F.array_join(recs, "; ").alias("recommendations"))


def context_line(s: DataFrame) -> DataFrame:
    """PRJ_CONTEXT_LINE: the one-line project summary."""
    line = F.concat_ws(" | ",
                       F.format_string("📊 Project Health: %d/100", F.col("health_score")),
                       F.format_string("📁 Files: %d (%s project)", F.col("total_files"), F.col("project_type")),
                       F.format_string("🌐 Languages: %d", F.col("languages")),
                       F.format_string("🔴 Errors: %d", F.col("error_count")),
                       F.concat(F.lit("🌿 Git: unknown"), F.when(F.col("is_dirty"), F.lit(" (dirty)")).otherwise(F.lit(" (clean)"))))
    return s.select("project_id", line.alias("context"))


def investigation_start(tasks: DataFrame) -> DataFrame:
    """INV_START: a snapshot named by the task's first 50 characters, a high-priority question, a description."""
    t = F.col("task")
    return tasks.select("task_id",
                        F.concat(F.lit("Investigation: "), F.substring(t, 1, 50), F.lit("...")).alias("snapshot_name"),
                        F.concat(F.lit("Starting investigation for: "), t).alias("description"),
                        F.concat(F.lit("How should I approach: "), t, F.lit("?")).alias("question"),
                        F.lit("high").alias("priority"), F.lit("discovery").alias("phase"),
                        F.lit(1).cast("bigint").alias("version"), F.lit("initial").alias("tags"))
