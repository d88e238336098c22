"""Code analysis: per-file issue counts and scores, project reports.

Plan: ``file_lines`` -> one projection that turns each line into a few numbers
and flags -> one exchange of these marks (never of text) by file and block of
lines -> windows inside a block for the neighbour rules and Go functions ->
file counts -> file scores -> ``groupBy(project_id)``. The texts are scanned
once; a huge file is many blocks.

FIXED VALUES: score weights, band limits and the recommendation texts in this
module are the source tool's values, kept verbatim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.operators import rules as R


#: Lines of a file that one window sorts.
BLOCK_LINES = 1 << 16


def line_marks(lines: DataFrame) -> DataFrame:
    """What the rules need of each line (lines carry ``language``), by block; no text.

    The first lines of a block are also in the block before it (``halo``), where
    only lines near its end look at them.
    """
    line, no = F.col("line"), F.col("line_no").cast("bigint")
    go = F.col("language") == F.lit("go")
    smells = R.go_smell_flags(line)
    block = F.floor((no - 1) / BLOCK_LINES)
    into = F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")), F.when(
        (block > 0) & ((no - 1) % BLOCK_LINES < C.NESTED_LOOP_LOOKAHEAD), F.struct((block - 1).alias("block"), F.lit(True).alias("halo"))))
    marks = lines.select(
        "file_id", no.alias("line_no"), R.long_line(line).alias("long_line"), R.todo_smell(line).alias("todo_comment"),
        (go & smells["panic_usage"]).alias("panic_usage"), (go & smells["debugging_print"]).alias("debugging_print"),
        F.size(R.security_hits(line)).alias("security"), R.string_concat(line).alias("string_concat"),
        line.contains("for ").alias("loop"), (go & line.contains("if err != nil {")).alias("opens"),
        (go & (R.trim_ws(line) == F.lit("}"))).alias("closes"), R.go_function_mark(go, line, no).alias("mark"),
        F.when(go, R.branch_keywords(line)).otherwise(0).alias("branches"), F.explode(F.filter(into, lambda x: x.isNotNull())).alias("at"))
    return marks.select("*", "at.block", "at.halo").drop("at")


def analysed_lines(marks: DataFrame) -> DataFrame:
    """Marks with what their neighbours say: nested_loop, empty_error and the start line of the Go function around them."""
    blocks = marks.repartition("file_id", "block")  # one exchange for both uses
    last = blocks.where(~F.col("halo")).groupBy("file_id", "block").agg(
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("line_no"))).alias("last"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file_id", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    ordered = Window.partitionBy("file_id", "block").orderBy("line_no")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    near, following = ordered.rangeBetween(1, C.NESTED_LOOP_LOOKAHEAD), ordered.rangeBetween(1, 1)
    open_function = F.coalesce(F.last("mark", ignorenulls=True).over(earlier), F.col("carried"))
    return (blocks.join(carried, ["file_id", "block"])
            .withColumns({
                "nested_loop": F.col("loop") & F.coalesce(F.max("loop").over(near), F.lit(False)),
                "empty_error": F.col("opens") & F.coalesce(F.max("closes").over(following), F.lit(False)),
                "func_line": F.when(F.col("mark") > 0, F.col("mark")).otherwise(F.nullif(open_function, F.lit(0)))})
            .where(~F.col("halo")))


def file_issue_counts(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Per analysed file: smells, security and performance issues, Go complexity suggestions, lines."""
    af = R.analyzable_files(files).select("file_id", "project_id", "rel_path", "language")
    seen = analysed_lines(line_marks(R.attach(lines, af, cols=("language",))))
    # a function may reach over blocks: its lines are summed for each block and function before files are
    parts = seen.groupBy("file_id", "func_line").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("security").alias("security_issues"), F.sum("branches").alias("branches"),
        *[F.count_if(c).alias(n) for c, n in (
            ("long_line", "long_lines"), ("todo_comment", "todo_comments"), ("panic_usage", "panic_usages"), ("debugging_print", "debug_prints"),
            ("string_concat", "string_concats"), ("empty_error", "empty_error_blocks"), ("nested_loop", "nested_loops"))])
    num = ["lines", "long_lines", "todo_comments", "panic_usages", "debug_prints", "security_issues", "string_concats",
           "empty_error_blocks", "nested_loops"]
    complex_function = F.col("func_line").isNotNull() & (F.col("branches") + 1 > C.COMPLEXITY_LIMIT)
    counts = parts.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in num], F.count_if(complex_function).alias("complex_functions"))
    return af.join(counts, "file_id", "left").select(
        "file_id", "project_id", "rel_path", "language",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in [*num, "complex_functions"]])


def file_scores(counts: DataFrame) -> DataFrame:
    """RUL_FILE_SCORE: complexity = min(100, 5 smells + 20 security + 10 perf), band, debt hours."""
    smells = F.col("long_lines") + F.col("todo_comments") + F.col("panic_usages") + F.col("debug_prints") \
        + F.col("empty_error_blocks")
    perf = F.col("nested_loops") + F.col("string_concats")
    sec = F.col("security_issues")
    c = F.least(F.lit(100), smells * 5 + sec * 20 + perf * 10)
    band = (F.when(c <= 20, "excellent").when(c <= 40, "good").when(c <= 60, "fair")
            .when(c <= 80, "poor").otherwise("critical"))
    suggestions = sec + perf + F.when(smells > 5, 1).otherwise(0) + F.col("complex_functions")
    return counts.select(
        "file_id", "project_id", "rel_path", "language", "lines",
        smells.cast("bigint").alias("code_smells"), sec.alias("security_issues"),
        perf.cast("bigint").alias("performance_issues"), suggestions.cast("bigint").alias("suggestions"),
        c.cast("bigint").alias("complexity_score"), band.alias("maintainability"),
        (sec * 4 + perf * 2 + smells).cast("bigint").alias("technical_debt"),
        (sec + perf + smells).cast("bigint").alias("total_issues"),
        "nested_loops", "string_concats",
    )


def project_summary(scores: DataFrame) -> DataFrame:
    """AGG_ANALYSIS: totals per project; overall = max(0, 100 - int(avg complexity))."""
    avg_c = F.avg("complexity_score")
    return scores.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("analyzed_files"),
        F.sum("lines").cast("bigint").alias("total_lines"),
        avg_c.alias("average_complexity"),
        F.sum("security_issues").cast("bigint").alias("total_security_issues"),
        F.sum("performance_issues").cast("bigint").alias("total_performance_issues"),
        F.sum("code_smells").cast("bigint").alias("total_code_smells"),
        F.sum("suggestions").cast("bigint").alias("total_suggestions"),
        F.sum("technical_debt").cast("bigint").alias("technical_debt_hours"),
        F.greatest(F.lit(0), F.lit(100) - F.floor(avg_c)).cast("bigint").alias("overall_score"),
    )


def maintainability_distribution(scores: DataFrame) -> DataFrame:
    """AGG_MAINTAINABILITY: files per band, zero-filled (fixed pivot values: no extra pass)."""
    bands = ["excellent", "good", "fair", "poor", "critical"]
    return (scores.groupBy("project_id").pivot("maintainability", bands).count()
            .na.fill(0, bands)
            .select("project_id", *[F.col(b).cast("bigint").alias(b) for b in bands]))


def complexity_distribution(scores: DataFrame) -> DataFrame:
    """AGG_COMPLEXITY_HIST: files per complexity bucket 0-20, 21-50, 51-80, 81+."""
    c = F.col("complexity_score")
    return scores.groupBy("project_id").agg(
        F.count_if(c <= 20).cast("bigint").alias("low"),
        F.count_if((c > 20) & (c <= 50)).cast("bigint").alias("medium"),
        F.count_if((c > 50) & (c <= 80)).cast("bigint").alias("high"),
        F.count_if(c > 80).cast("bigint").alias("very_high"),
    )


def language_quality(scores: DataFrame) -> DataFrame:
    """AGG_LANG_QUALITY: per project and language: files, totals and averages."""
    return scores.groupBy("project_id", "language").agg(
        F.count(F.lit(1)).cast("bigint").alias("files"),
        F.sum("complexity_score").cast("bigint").alias("total_complexity"),
        F.sum("total_issues").cast("bigint").alias("total_issues"),
        F.avg("complexity_score").alias("avg_complexity"),
        F.avg("total_issues").alias("avg_issues"),
    )


def security_report(scores: DataFrame) -> DataFrame:
    """AGG_SECURITY: issues by severity (all analyzer issues are high), risk, advice."""
    high = F.sum("security_issues").cast("bigint")
    base = scores.groupBy("project_id").agg(high.alias("high"))
    crit, med, low = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    risk = F.least(F.lit(100), crit * 10 + F.col("high") * 7 + med * 4 + low)
    advice = F.filter(F.array(
        F.when(crit > 0, F.lit("🚨 Address critical security issues immediately")),
        F.when(F.col("high") > 0, F.lit("🔒 Fix high-priority security vulnerabilities")),
        F.when(med + low > 10, F.lit("🛡️ Consider implementing automated security scanning")),
    ), lambda x: x.isNotNull())
    return base.select("project_id", F.col("high").alias("total_issues"), crit.alias("critical"),
                       "high", med.alias("medium"), low.alias("low"),
                       risk.cast("bigint").alias("risk_score"),
                       F.array_join(advice, "; ").alias("recommendations"))


def performance_report(scores: DataFrame) -> DataFrame:
    """AGG_PERFORMANCE: issues by type with priority, score = max(0, 100 - int(50 x issues/files))."""
    per = scores.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("nested_loops").cast("bigint").alias("nested_loops"),
        F.sum("string_concats").cast("bigint").alias("string_concatenation"),
    )
    total = F.col("nested_loops") + F.col("string_concatenation")
    score = F.when(F.col("files") == 0, 100).otherwise(
        F.greatest(F.lit(0), F.lit(100) - F.floor(total / F.col("files") * 50)))
    return per.select("project_id", total.cast("bigint").alias("total_issues"), "nested_loops",
                      "string_concatenation", score.cast("bigint").alias("performance_score"),
                      F.lit(C.OPTIMIZATION_PRIORITY["nested_loops"]).alias("nested_loops_priority"),
                      F.lit(C.OPTIMIZATION_PRIORITY["string_concatenation"]).alias("string_concatenation_priority"))


def project_recommendations(summary: DataFrame) -> DataFrame:
    """REC_PROJECT: threshold advice over the project summary (one row per advice)."""
    s = summary
    recs = F.array(
        F.when(F.col("total_security_issues") > 0,
               F.format_string("🔒 Address %d security issues immediately - these pose serious risks",
                               F.col("total_security_issues"))),
        F.when(F.col("average_complexity") > 50,
               F.lit("🔧 Consider refactoring high-complexity functions to improve maintainability")),
        F.when(F.col("technical_debt_hours") > 40,
               F.format_string("⏰ Allocate %d hours to address technical debt", F.col("technical_debt_hours"))),
        F.when(F.col("total_performance_issues") > 10,
               F.lit("⚡ Performance optimization opportunities identified - consider prioritizing high-impact improvements")),
        F.when(F.col("overall_score") > 80,
               F.lit("✅ Code quality is excellent! Consider implementing automated quality gates"))
        .when(F.col("overall_score") < 60,
              F.lit("⚠️ Code quality needs improvement - focus on addressing critical issues first")),
    )
    return s.select("project_id", F.posexplode(F.filter(recs, lambda x: x.isNotNull())).alias("pos", "recommendation"))


def immediate_actions(summary: DataFrame) -> DataFrame:
    """REC_IMMEDIATE: security > 0, average complexity > 80, performance issues > 5."""
    recs = F.array(
        F.when(F.col("total_security_issues") > 0, F.lit("Fix security vulnerabilities")),
        F.when(F.col("average_complexity") > 80, F.lit("Refactor high-complexity functions")),
        F.when(F.col("total_performance_issues") > 5, F.lit("Optimize performance bottlenecks")),
    )
    return summary.select("project_id", F.explode(F.filter(recs, lambda x: x.isNotNull())).alias("action"))
