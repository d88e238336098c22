"""Tool output and process output to diagnostic rows.

Every parser is a projection of regex extractions over lines (JVM-side); the
static pattern catalogs become one ``coalesce(when(...))`` chain per language,
so "first matching pattern wins" needs no join and no per-line Python.
Per-run results (tracebacks, test summaries) are aggregations keyed by run,
which Spark reduces map-side first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.grams import GRAM, lines_with_words
from codelens.functions.text import any_of, basename, extract, java_regex, rlike, trim_ws
from codelens.session import ensure_checkpoint_dir

ERROR_COLS = ["source", "file", "line", "column", "type", "message", "code"]
FEW_PATTERNS = 16  # patterns of one process that are simply tested on its lines


def _int(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


# ------------------------------------------------------------ compiler / linter lines

def tsc_errors(lines: DataFrame) -> DataFrame:
    """ERR_TSC (plug-in): ``file(l,c): error|warning TSn: msg``; type import / syntax / type."""
    pat = r"(.+)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)"
    t = trim_ws(F.col("line"))
    msg = extract(t, pat, 6)
    etype = (F.when(msg.contains("Cannot find module"), "import")
             .when(msg.contains("syntax"), "syntax").otherwise("type"))
    return (lines.where(rlike(t, pat))
            .select("*", F.lit("tsc").alias("source"), extract(t, pat, 1).alias("file"),
                    _int(extract(t, pat, 2)).alias("line_number"), _int(extract(t, pat, 3)).alias("column"),
                    etype.alias("type"), msg.alias("message"), extract(t, pat, 5).alias("code")))


def tsc_core_errors(lines: DataFrame) -> DataFrame:
    """ERR_TSC (core watcher): lines with ``error TS``; type error."""
    pat = r"(.+)\((\d+),(\d+)\): error (TS\d+): (.+)"
    ln = F.col("line")
    return (lines.where(ln.contains("error TS") & rlike(ln, pat))
            .select("*", F.lit("typescript").alias("source"), extract(ln, pat, 1).alias("file"),
                    _int(extract(ln, pat, 2)).alias("line_number"), _int(extract(ln, pat, 3)).alias("column"),
                    F.lit("error").alias("type"), extract(ln, pat, 5).alias("message"),
                    extract(ln, pat, 4).alias("code")))


def go_build_errors(lines: DataFrame) -> DataFrame:
    """ERR_GO_BUILD: lines with ``.go:`` and ``error`` -> ``file:l:c: msg``; type error."""
    pat = r"(.+\.go):(\d+):(\d+): (.+)"
    ln = F.col("line")
    return (lines.where(ln.contains(".go:") & ln.contains("error") & rlike(ln, pat))
            .select("*", F.lit("go").alias("source"), extract(ln, pat, 1).alias("file"),
                    _int(extract(ln, pat, 2)).alias("line_number"), _int(extract(ln, pat, 3)).alias("column"),
                    F.lit("error").alias("type"), extract(ln, pat, 4).alias("message"),
                    F.lit("").alias("code")))


def flake8_errors(lines: DataFrame) -> DataFrame:
    """ERR_FLAKE8: ``file:l:c: CODE msg`` -> lint."""
    pat = r"(.+):(\d+):(\d+): (\w+) (.+)"
    ln = F.col("line")
    return (lines.where(rlike(ln, pat))
            .select("*", F.lit("flake8").alias("source"), extract(ln, pat, 1).alias("file"),
                    _int(extract(ln, pat, 2)).alias("line_number"), _int(extract(ln, pat, 3)).alias("column"),
                    F.lit("lint").alias("type"), extract(ln, pat, 5).alias("message"),
                    extract(ln, pat, 4).alias("code")))


def mypy_errors(lines: DataFrame) -> DataFrame:
    """ERR_MYPY: ``file:l: error|warning|note: msg`` -> type; severity kept (note -> info)."""
    pat = r"(.+):(\d+): (error|warning|note): (.+)"
    ln = F.col("line")
    sev = extract(ln, pat, 3)
    return (lines.where(rlike(ln, pat))
            .select("*", F.lit("mypy").alias("source"), extract(ln, pat, 1).alias("file"),
                    _int(extract(ln, pat, 2)).alias("line_number"), F.lit(0).cast("bigint").alias("column"),
                    F.lit("type").alias("type"), extract(ln, pat, 4).alias("message"), F.lit("").alias("code"),
                    F.when(sev == "note", "info").otherwise(sev).alias("severity")))


def log_keyword_errors(lines: DataFrame) -> DataFrame:
    """ERR_LOG_KEYWORDS: error / exception / fatal anywhere (case-insensitive) -> runtime error, whole line."""
    low = F.lower(F.col("line"))
    hit = low.contains("error") | low.contains("exception") | low.contains("fatal")
    return (lines.where(hit)
            .select("*", F.lit("runtime").alias("source"), F.lit(None).cast("string").alias("file"),
                    F.lit(0).cast("bigint").alias("line_number"), F.lit(0).cast("bigint").alias("column"),
                    F.lit("error").alias("type"), F.col("line").alias("message"), F.lit("").alias("code")))


# ------------------------------------------------------------ catalog scan

def _catalog_scan(lines: DataFrame, languages: list[str], of: Column | None = None, trim_message: bool = False) -> DataFrame:
    """Lines that a catalog pattern matches, with the fields of the first such pattern.

    A line is tested against the patterns of its language (``of``; else of the
    one language) for the number of the first hit only; what the hit extracts
    is looked up by that number, which keeps the generated code small.
    """
    ln = F.col("line")
    rows = [(lang, *row) for lang in languages for row in C.LANGUAGE_PATTERNS[lang]]
    tested = [F.when(rlike(ln, r[1]) if of is None else (of == r[0]) & rlike(ln, r[1]), F.lit(i + 1)) for i, r in enumerate(rows)]
    fields = F.array(*[F.struct(
        F.lit(lang).alias("source"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
        *[F.lit(java_regex(x) if x else None).cast("string").alias(n) for n, x in (("file", file_re), ("line", line_re), ("column", col_re))])
        for lang, _, kind, severity, file_re, line_re, col_re in rows])
    # no hit: the slice is null and gives no row; the tests run once for each line
    hits = lines.select("*", F.explode(F.slice(fields, F.coalesce(*tested), F.lit(1))).alias("_p"))

    def taken(name):
        return F.when(F.rlike(ln, F.col(f"_p.{name}")), F.expr(f"regexp_extract(line, _p.`{name}`, 1)"))

    return hits.select(*[F.col(f"`{c}`") for c in lines.columns], F.col("_p.source").alias("source"), taken("file").alias("file"), _int(taken("line")).alias("line_number"),
                       _int(taken("column")).alias("column"), F.col("_p.type").alias("type"), F.col("_p.severity").alias("severity"),
                       (trim_ws(ln) if trim_message else ln).alias("message"), F.lit("").alias("code"))


def pattern_scan(lines: DataFrame, language: str, trim_message: bool = False) -> DataFrame:
    """ERR_PATTERN_SCAN: first matching catalog pattern per line gives source/type; message = line."""
    return _catalog_scan(lines, [language], trim_message=trim_message)


def pattern_scan_by_language(lines: DataFrame, language_col: str = "language") -> DataFrame:
    """Scan lines whose language column names a catalog (one pass)."""
    return _catalog_scan(lines, list(C.LANGUAGE_PATTERNS), of=F.col(language_col))


def build_output_errors(lines: DataFrame, language_col: str = "language") -> DataFrame:
    """ERR_BUILD_OUTPUT: per-language scan; TypeScript output also runs the JavaScript patterns."""
    main = pattern_scan_by_language(lines, language_col)
    ts_as_js = pattern_scan(lines.where(F.col(language_col) == "typescript"), "javascript")
    return main.unionByName(ts_as_js)


# ------------------------------------------------------------ lint JSON

ESLINT_SCHEMA = ("array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,"
                 "message:string,line:int,column:int,nodeType:string,messageId:string>>>>")
TSLINT_SCHEMA = ("array<struct<name:string,ruleName:string,startPosition:struct<line:int,character:int>,"
                 "endPosition:struct<line:int,character:int>,failure:string,ruleSeverity:string>>")


def _text_fallback(runs: DataFrame, parsed: str, language: str) -> DataFrame:
    """Outputs that are not JSON: split to lines and scan with the language catalog."""
    bad = runs.where(F.col(parsed).isNull())
    lines = bad.select("*", F.explode(F.split(F.col("output"), "\n")).alias("line"))
    return pattern_scan(lines, language).drop("line", parsed)


def eslint_errors(runs: DataFrame) -> DataFrame:
    """ERR_ESLINT: JSON report -> one row per message; non-JSON output -> JavaScript pattern scan."""
    p = runs.withColumn("_j", F.from_json("output", ESLINT_SCHEMA))
    ok = (p.where(F.col("_j").isNotNull())
          .select("*", F.explode("_j").alias("_r"))
          .select("*", F.col("_r.filePath").alias("file"), F.explode("_r.messages").alias("_m"))
          .select(*runs.columns, F.lit("eslint").alias("source"), "file",
                  _int(F.col("_m.line")).alias("line_number"), _int(F.col("_m.column")).alias("column"),
                  F.lit("lint").alias("type"), F.col("_m.message").alias("message"),
                  F.col("_m.ruleId").alias("code")))
    fb = _text_fallback(p, "_j", "javascript").drop("severity")
    return ok.unionByName(fb)


def tslint_errors(runs: DataFrame) -> DataFrame:
    """ERR_TSLINT: JSON report, 0-based positions + 1; non-JSON output -> TypeScript pattern scan."""
    p = runs.withColumn("_j", F.from_json("output", TSLINT_SCHEMA))
    ok = (p.where(F.col("_j").isNotNull())
          .select("*", F.explode("_j").alias("_r"))
          .select(*runs.columns, F.lit("tslint").alias("source"), F.col("_r.name").alias("file"),
                  (_int(F.col("_r.startPosition.line")) + 1).alias("line_number"),
                  (_int(F.col("_r.startPosition.character")) + 1).alias("column"),
                  F.lit("lint").alias("type"), F.col("_r.failure").alias("message"),
                  F.col("_r.ruleName").alias("code")))
    fb = _text_fallback(p, "_j", "typescript").drop("severity")
    return ok.unionByName(fb)


# ------------------------------------------------------------ whole-run parsers

def python_syntax_errors(lines: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """ERR_PY_TRACEBACK: first Syntax/IndentationError of a run, with the last ``File`` line before it."""
    err_pat = r"(SyntaxError|IndentationError): (.+)"
    file_pat = r'File "(.+)", line (\d+)'
    ln = F.col("line")
    first_err = (lines.where(rlike(ln, err_pat))
                 .groupBy(run).agg(F.min_by(F.struct(extract(ln, err_pat, 1).alias("etype"),
                                                     extract(ln, err_pat, 2).alias("emsg")), F.col(seq)).alias("e"),
                                   F.min(seq).alias("_eseq")))
    files = lines.where(rlike(ln, file_pat)).select(
        run, seq, extract(ln, file_pat, 1).alias("_file"), extract(ln, file_pat, 2).alias("_line"))
    last_file = (files.join(first_err.select(run, "_eseq"), run)
                 .where(F.col(seq) < F.col("_eseq"))
                 .groupBy(run).agg(F.max_by(F.struct("_file", "_line"), F.col(seq)).alias("f")))
    return (first_err.join(last_file, run)
            .where((F.col("f._file") != "") & (F.col("e.emsg") != ""))
            .select(run, F.lit("python").alias("source"), F.col("f._file").alias("file"),
                    _int(F.col("f._line")).alias("line_number"), F.lit("syntax").alias("type"),
                    F.concat_ws(": ", "e.etype", "e.emsg").alias("message")))


def node_syntax_errors(lines: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """ERR_NODE_SYNTAX: first ``SyntaxError: m`` of a run and its first ``at ..:l:c`` location."""
    msg_pat = r"SyntaxError: (.+)"
    loc_pat = r"at .*:(\d+):(\d+)"
    ln = F.col("line")
    msgs = (lines.where(rlike(ln, msg_pat))
            .groupBy(run).agg(F.min_by(extract(ln, msg_pat, 1), F.col(seq)).alias("message")))
    locs = (lines.where(rlike(ln, loc_pat))
            .groupBy(run).agg(F.min_by(F.struct(extract(ln, loc_pat, 1).alias("l"), extract(ln, loc_pat, 2).alias("c")),
                                       F.col(seq)).alias("loc")))
    return (msgs.join(locs, run, "left")
            .select(run, F.lit("node").alias("source"), _int(F.col("loc.l")).alias("line_number"),
                    _int(F.col("loc.c")).alias("column"), F.lit("syntax").alias("type"), "message"))


# ------------------------------------------------------------ process output classification

def classify_process_lines(lines: DataFrame, custom_patterns: list[str] = ()) -> DataFrame:
    """ERR_CLASSIFY: a line is an error if any default (or custom) pattern matches.

    The 25 defaults plus custom patterns are one alternation regex (one scan
    per line); severity and type come from the line itself.
    """
    ln = F.col("line")
    gate = java_regex(any_of(list(C.PROCESS_ERROR_PATTERNS) + list(custom_patterns)))
    return (lines.where(ln.rlike(gate))
            .withColumn("severity", error_severity(ln)).withColumn("error_type", error_type(ln))
            .withColumn("message", ln))


def error_severity(ln: Column) -> Column:
    return F.when(rlike(ln, C.WARNING_PATTERN), "warning").otherwise("error")


def error_type(ln: Column) -> Column:
    """compilation > test > server > runtime, decided by the line text."""
    etype = F.lit(C.DEFAULT_ERROR_TYPE)
    for name, pat in reversed(C.ERROR_TYPE_PATTERNS):
        etype = F.when(rlike(ln, pat), name).otherwise(etype)
    return etype


def _best(sets: list[list[str]]) -> list[str]:
    """Of several sets of which a match contains a member each, the one whose shortest member is longest."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=[])


def _needed(tree) -> list[str]:
    """Strings of which every match of a parsed regex contains one ([]: nothing is known); ASCII letters of any case."""
    sets, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is re._constants.LITERAL and 32 <= arg < 127:
            run += chr(arg).lower()
            continue
        if run:
            sets.append([run])
            run = ""
        if op is re._constants.SUBPATTERN:
            sets.append(_needed(arg[-1]))
        elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and arg[0] > 0:
            sets.append(_needed(arg[-1]))
        elif op is re._constants.BRANCH:
            members = [_needed(b) for b in arg[1]]
            sets.append(sorted({x for m in members for x in m}) if all(members) else [])
    return _best([s for s in sets if s])


def needed_strings(pattern: str) -> list[str]:
    """Strings of at least ``GRAM`` characters of which every match of a valid pattern contains one, folded; [] if unknown.

    Nested classes, class intersections and the verbose flag mean other things to other engines: nothing is known.
    """
    if re.search(r"\[[^\]]*\[|&&|\(\?[a-z]*x", pattern):
        return []
    found = _needed(re._parser.parse(pattern))
    return found if found and min(map(len, found)) >= GRAM else []


def folded(text: Column) -> Column:
    """Text in which an ASCII string is found by its lower-case form whenever a regex finds it, with or without ``(?i)``."""
    # the four other characters that Unicode folds to an ASCII letter
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def _checked(patterns: pd.Series) -> pd.DataFrame:
    """The JVM form of each user pattern and what its matches contain, or why it is no pattern (checked by an equivalent parser, outside the line path)."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
            # possessive and recursive forms that only one of the two engines knows are not RE2 either
            known = not re.search(r"\(\?[<P!=]|\\[1-9]|[*+?}]\+", p)
            out.append((java_regex(p), needed_strings(p), None) if known else (None, [], "not supported"))
        except (re.error, TypeError) as e:
            out.append((None, [], str(e)))
    return pd.DataFrame(out, columns=["regex", "needed", "error"])


def check_patterns(user_patterns: DataFrame, owner: str = "pid") -> DataFrame:
    """(owner, pattern, regex, needed, error): each distinct user pattern compiled once; a bad one has an error and no regex.

    ``needed`` are strings of which a matching line, ``folded``, contains one (empty: any line may match).
    """
    spark = user_patterns.sparkSession
    # a fixed number of partitions: patterns are short, but each takes Python a while
    distinct = user_patterns.select("pattern").distinct().repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "pattern")
    # not deterministic as the optimizer sees it: filters on what it finds stay behind the shuffle, so that it runs once for each pattern
    check = F.pandas_udf(_checked, "regex string, needed array<string>, error string").asNondeterministic()
    checked = distinct.withColumn("_c", check("pattern")).select("pattern", "_c.regex", "_c.needed", "_c.error")
    return user_patterns.join(checked, "pattern").select(owner, "pattern", "regex", "needed", "error")


def rejected_patterns(user_patterns: DataFrame) -> DataFrame:
    """(pid, pattern, error) of the user patterns that cannot be used."""
    return check_patterns(user_patterns).where("error IS NOT NULL").select("pid", "pattern", "error")


def _searched_lines(lines: DataFrame, members: DataFrame | None, searched: DataFrame) -> DataFrame:
    """Distinct (pid, _h) of the lines (pid, _h, line) that a pattern (_list, regex, needed) of a list of their process matches.

    Each different text meets each different pattern once, however many
    processes share them: strings first, then regexes, then the lists, then the
    processes.
    """
    words = searched.select("regex", "needed").distinct().select("regex", F.explode("needed").alias("word"))
    texts = lines.select("_h", "line").dropDuplicates(["_h"]).withColumn("_l", folded(F.col("line")))
    found = lines_with_words(texts, words.select("word").distinct(), [], carry=("line",))
    matched = found.join(words, "word").where("rlike(line, regex)").select("_h", "regex").distinct()
    own = lines.select("pid", "_h").distinct()
    own = own.withColumn("_list", F.col("pid")) if members is None else own.join(members, "pid")
    hits = (own.select("_list", "_h").distinct().join(matched, "_h")
            .join(searched.select("_list", "regex"), ["_list", "regex"], "left_semi").select("_list", "_h").distinct())
    return own.join(hits, ["_list", "_h"], "left_semi").select("pid", "_h").distinct()


def classify_with_user_patterns(lines: DataFrame, user_patterns: DataFrame, few: int = FEW_PATTERNS, members: DataFrame | None = None) -> DataFrame:
    """UDX_PATTERNS: per-process user patterns (pid, pattern) added to the defaults.

    Processes may share lists of patterns: ``user_patterns`` are (list, pattern)
    then and ``members`` (pid, list) names the lists of each process; a list's
    patterns are never repeated for its processes.

    A line is a hit by the default patterns or by any of its process's own. Up
    to ``few`` patterns of a list come to the lines as one array and are
    tested one by one. Of more, those whose matches must contain a string are
    looked up by that string's rarest q-gram, once for each different line that
    is no hit yet, and tested on the lines that contain it; only the others stay
    in the array. Patterns that are no valid regex are left out, as
    ``rejected_patterns`` tells. Null lines and lines of no process are no hits
    of user patterns; other columns of ``lines`` stay (``_patterns``, ``_many``
    and ``_h`` are names of this function). The patterns are checked by a job
    when the frame is built and stay in the checkpoint folder.
    """
    ln = F.col("line")
    default_hit = ln.rlike(java_regex(any_of(C.PROCESS_ERROR_PATTERNS)))
    if members is not None:
        members = members.select("pid", F.col("list").alias("_list")).where(F.col("_list").isNotNull()).distinct()
    own = (check_patterns(user_patterns.withColumnRenamed("pid" if members is None else "list", "_list"), "_list")
           .where("error IS NULL").select("_list", "regex", "needed").distinct())
    ensure_checkpoint_dir(lines.sparkSession)
    own = own.checkpoint()  # read by several branches, checked once
    # a list's patterns stay rows; only those that are tested one by one are put into an array
    sizes = own.groupBy("_list").agg((F.count(F.lit(1)) > few).alias("_large"))
    own = own.join(sizes, "_list").withColumn("_apart", F.col("_large") & (F.size("needed") > 0))
    direct = own.groupBy("_list").agg(F.collect_set(F.when(~F.col("_apart"), F.col("regex"))).alias("_patterns"), F.max("_apart").alias("_many"))
    if members is None:
        direct = direct.withColumnRenamed("_list", "pid")
    else:
        direct = (members.join(direct, "_list").groupBy("pid")
                  .agg(F.flatten(F.collect_list("_patterns")).alias("_patterns"), F.max("_many").alias("_many")))
    tested = lines.join(direct, "pid", "left")
    hit = default_hit | F.exists(F.coalesce("_patterns", F.array().cast("array<string>")), lambda p: F.rlike(ln, p))
    rest = tested.where(F.col("_many") & ~F.coalesce(hit, F.lit(False))).withColumn("_h", F.sha2("line", 256))
    found = _searched_lines(rest, members, own.where("_apart").select("_list", "regex", "needed"))
    columns = [F.col(f"`{c}`") for c in lines.columns]
    hits = tested.where(hit).select(*columns).unionByName(rest.join(found, ["pid", "_h"], "left_semi").select(*columns))
    return (hits.withColumn("severity", error_severity(ln)).withColumn("error_type", error_type(ln))
            .withColumn("message", ln))


# ------------------------------------------------------------ test summaries

def go_test_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TST_GO: lines with PASS count passed, else lines with FAIL count failed."""
    ln = F.col("line")
    passed = ln.contains("PASS")
    failed = ~passed & ln.contains("FAIL")
    return (lines.groupBy(*keys).agg(F.count_if(passed).cast("bigint").alias("passed"),
                                      F.count_if(failed).cast("bigint").alias("failed"))
            .withColumn("total", F.col("passed") + F.col("failed")))


def pytest_summary(lines: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """TST_PYTEST: the last line with both 'passed' and 'failed' gives the counts (regex, not Sscanf)."""
    ln = F.col("line")
    s = lines.where(ln.contains("passed") & ln.contains("failed"))
    last = s.groupBy(*keys).agg(F.max_by(ln, F.col(seq)).alias("_l"))
    f = _int(extract(F.col("_l"), r"(\d+) failed", 1))
    p = _int(extract(F.col("_l"), r"(\d+) passed", 1))
    return last.select(*keys, f.alias("failed"), p.alias("passed"), (f + p).alias("total"))


def jest_summary(lines: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """TST_JEST: last ``Tests: F failed, P passed, T total`` line per run."""
    ln = F.col("line")
    s = lines.where(ln.contains("Tests:") & ln.contains("total"))
    last = s.groupBy(*keys).agg(F.max_by(ln, F.col(seq)).alias("_l"))
    return last.select(*keys, _int(extract(F.col("_l"), r"(\d+) failed", 1)).alias("failed"),
                       _int(extract(F.col("_l"), r"(\d+) passed", 1)).alias("passed"),
                       _int(extract(F.col("_l"), r"(\d+) total", 1)).alias("total"))


def unittest_summary(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TST_UNITTEST: output containing OK -> 1 passed, else FAILED -> 1 failed."""
    ln = F.col("line")
    agg = lines.groupBy(*keys).agg(F.max(ln.contains("OK")).alias("_ok"), F.max(ln.contains("FAILED")).alias("_f"))
    passed = F.when(F.col("_ok"), 1).otherwise(0)
    failed = F.when(~F.col("_ok") & F.col("_f"), 1).otherwise(0)
    return agg.select(*keys, passed.cast("bigint").alias("passed"), failed.cast("bigint").alias("failed"),
                      (passed + failed).cast("bigint").alias("total"))


# ------------------------------------------------------------ health

def health(errors: DataFrame, projects: DataFrame) -> DataFrame:
    """AGG_HEALTH: 100 - 10 per error - 3 per warning (floor 0); debt by counts. Only types error/warning count."""
    c = errors.groupBy("project_id").agg(F.count_if(F.col("type") == "error").alias("e"),
                                         F.count_if(F.col("type") == "warning").alias("w"))
    j = projects.join(c, "project_id", "left").fillna(0, ["e", "w"])
    e, w = F.col("e"), F.col("w")
    debt = F.when((e > 10) | (w > 50), "high").when((e > 5) | (w > 20), "medium").otherwise("low")
    return j.select("project_id", F.greatest(F.lit(0), 100 - 10 * e - 3 * w).cast("bigint").alias("score"),
                    e.cast("bigint").alias("error_count"), w.cast("bigint").alias("warning_count"),
                    debt.alias("technical_debt"))


def health_band(score: Column) -> Column:
    """PRJ_HEALTH_BAND: >= 80 healthy, >= 50 warning, else error."""
    return F.when(score >= 80, "healthy").when(score >= 50, "warning").otherwise("error")


def file_basename(path: Column) -> Column:
    return basename(path)
