"""Project structure: file scopes, languages, directories, structure aggregates, todos, search.

Input ``files``: file_id, project_id, rel_path, content. Path predicates run
on ``split(rel_path, '/')`` (no listing loop); languages come from a fixed,
broadcast extension map; per-project results are ``groupBy(project_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.text import basename, count_substr, file_ext, map_lookup

# ---- FIXED VALUES: language support table (key, display name, extensions, config files, lint tools) ----
LANGUAGES = [
    ("javascript", "JavaScript", [".js", ".jsx", ".mjs", ".cjs"],
     ["package.json", ".eslintrc.js", ".eslintrc.json", "babel.config.js", "webpack.config.js"],
     ["eslint", "jshint", "prettier", "biome"]),
    ("typescript", "TypeScript", [".ts", ".tsx"], ["tsconfig.json", "tsconfig.build.json", "tslint.json"],
     ["tslint", "eslint", "prettier", "biome"]),
    ("python", "Python", [".py", ".pyw", ".pyx", ".pyi"],
     ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "poetry.lock"],
     ["pylint", "flake8", "black", "mypy", "ruff", "bandit"]),
    ("go", "Go", [".go"], ["go.mod", "go.sum", "go.work"], ["golint", "golangci-lint", "staticcheck", "vet"]),
    ("java", "Java", [".java"], ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle"],
     ["checkstyle", "pmd", "spotbugs", "errorprone"]),
    ("csharp", "C#", [".cs", ".csx"], [".csproj", ".sln", "global.json", "Directory.Build.props"],
     ["stylecop", "editorconfig", "sonaranalyzer"]),
    ("rust", "Rust", [".rs"], ["Cargo.toml", "Cargo.lock", "rust-toolchain.toml"], ["clippy", "rustfmt", "miri"]),
    ("php", "PHP", [".php", ".phtml", ".php3", ".php4", ".php5"],
     ["composer.json", "composer.lock", "phpunit.xml", "psalm.xml"], ["phpstan", "psalm", "phpcs", "phpmd"]),
    ("ruby", "Ruby", [".rb", ".rbw", ".rake", ".gemspec"], ["Gemfile", "Gemfile.lock", "Rakefile", ".rubocop.yml"],
     ["rubocop", "reek", "flog", "brakeman"]),
]
# ---- FIXED VALUES: main files per language ----
LANGUAGE_MAIN_FILES = {
    "javascript": ["index.js", "app.js", "main.js", "server.js"],
    "typescript": ["index.ts", "app.ts", "main.ts", "server.ts"],
    "python": ["main.py", "app.py", "manage.py", "__init__.py"],
    "go": ["main.go", "cmd.go"],
    "java": ["Main.java", "Application.java", "App.java"],
    "csharp": ["Program.cs", "Startup.cs", "Main.cs"],
    "rust": ["main.rs", "lib.rs"],
    "php": ["index.php", "app.php", "bootstrap.php"],
    "ruby": ["app.rb", "main.rb", "config.ru"],
}
# ---- FIXED VALUES: test-name patterns (any path element containing one) ----
TEST_PATTERNS = ["test", "tests", "spec", "specs", "__tests__", ".test.", ".spec.", "_test.", "_spec."]
# ---- FIXED VALUES: suggestion-engine extension map (default unknown) ----
SUGGESTION_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".c": "c",
    ".cpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".rs": "rust", ".html": "html",
    ".css": "css", ".sql": "sql", ".sh": "bash",
}
# ---- FIXED VALUES: graph-view extension map (default unknown) ----
GRAPH_LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python",
    ".go": "go", ".java": "java", ".cs": "csharp", ".rs": "rust", ".php": "php", ".rb": "ruby",
}

LANGUAGE_SKIP_DIRS = ["node_modules", "vendor", "target", "dist", "build", "__pycache__", "venv", "env"]
PLUGIN_SKIP_DIRS = ["node_modules", "vendor", "target", "dist", "build", "__pycache__", ".git"]


def ext_language_map() -> dict[str, str]:
    return {e: key for key, _, exts, _, _ in LANGUAGES for e in exts}


def dirs_of(path: Column) -> Column:
    """Directory elements of a relative path (all but the last element)."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def structure_scope(path: Column) -> Column:
    """Structure walk: no element starting with '.' (except .env/.gitignore), no pruned directory."""
    parts = F.split(path, "/")
    dot = F.exists(parts, lambda s: s.startswith(".") & ~s.isin(C.STRUCTURE_KEEP_DOTNAMES))
    pruned = F.exists(dirs_of(path), lambda s: s.isin(C.STRUCTURE_SKIP_DIRS))
    return ~dot & ~pruned


def language_scope(path: Column) -> Column:
    """Language walk: dot-directories (except .env) and build/vendor directories pruned; dot-files kept."""
    d = dirs_of(path)
    return ~F.exists(d, lambda s: (s.startswith(".") & (s != ".env")) | s.isin(LANGUAGE_SKIP_DIRS))


def plugin_scope(path: Column) -> Column:
    """Plug-in file lists: build/vendor/.git directories pruned; other dot-directories kept."""
    return ~F.exists(dirs_of(path), lambda s: s.isin(PLUGIN_SKIP_DIRS))


# ---- FIXED VALUES: extra path substrings the Python and JavaScript plug-ins drop ----
PYTHON_DROP = ["venv", "__pycache__", ".env", "site-packages"]
JS_DROP = ["node_modules", "dist", "build"]


def python_plugin_scope(path: Column) -> Column:
    """Python plug-in: plug-in scope, minus paths containing venv / __pycache__ / .env / site-packages."""
    out = plugin_scope(path)
    for s in PYTHON_DROP:
        out = out & ~path.contains(s)
    return out


def js_plugin_scope(path: Column) -> Column:
    """JavaScript plug-in: plug-in scope, minus paths containing node_modules / dist / build."""
    out = plugin_scope(path)
    for s in JS_DROP:
        out = out & ~path.contains(s)
    return out


def with_file_attrs(files: DataFrame) -> DataFrame:
    """Extension, base name, core language, code / analyzable / main / config flags, size."""
    p = F.col("rel_path")
    name = F.lower(basename(p))
    return files.select(
        "*", file_ext(p).alias("ext_l"), name.alias("name_l"),
        map_lookup(C.CORE_LANGUAGES, file_ext(p), "text").alias("language"),
        file_ext(p).isin(C.CODE_EXTS).alias("is_code"),
        file_ext(p).isin(C.ANALYZABLE_EXTS).alias("is_analyzable"),
        name.isin(C.MAIN_FILES).alias("is_main"),
        name.isin(C.CONFIG_FILES).alias("is_config"),
        F.octet_length("content").cast("bigint").alias("size"),
    )


def line_counts(content: Column) -> tuple[Column, Column]:
    """PRJ_LINE_COUNT: scanner lines (no final empty line; empty = 0) and split lines (newlines + 1)."""
    nl = count_substr(content, "\n")
    scanner = nl + F.when((F.length(content) > 0) & ~content.endswith("\n"), 1).otherwise(0)
    return scanner.cast("bigint"), (nl + 1).cast("bigint")


def directories(files: DataFrame) -> DataFrame:
    """PRJ_DIRS: one row per directory (structure scope) with purpose and direct file count."""
    f = files.where(structure_scope(F.col("rel_path")))
    d = dirs_of(F.col("rel_path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(d)), lambda i: F.array_join(F.slice(d, 1, i), "/"))
    parent = F.array_join(d, "/")
    every = (f.where(F.size(d) > 0).select("project_id", F.explode(prefixes).alias("dir")).distinct())
    direct = f.where(F.size(d) > 0).groupBy("project_id", parent.alias("dir")).agg(
        F.count(F.lit(1)).cast("bigint").alias("file_count"))
    purpose = map_lookup(C.DIR_PURPOSES, F.lower(basename(F.col("dir"))), "general")
    return (every.join(direct, ["project_id", "dir"], "left").fillna(0, ["file_count"])
            .withColumn("purpose", purpose))


def structure(files: DataFrame) -> DataFrame:
    """AGG_STRUCTURE: files and size in structure scope; main and config file counts and first paths.

    The full main/config lists are rows (``prj_main_file`` / ``prj_config_file``), not a
    per-project array, so no project's file list is gathered into one row.
    """
    f = with_file_attrs(files).where(structure_scope(F.col("rel_path")))
    return f.groupBy("project_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_files"),
        F.sum("size").cast("bigint").alias("total_size"),
        F.count_if("is_main").cast("bigint").alias("main_files"),
        F.count_if("is_config").cast("bigint").alias("config_files"),
        F.min(F.when(F.col("is_main"), F.col("rel_path"))).alias("first_main_file"),
        F.min(F.when(F.col("is_config"), F.col("rel_path"))).alias("first_config_file"),
    )


def structure_lists(files: DataFrame) -> DataFrame:
    """AGG_STRUCTURE with its lists: a row for each main or config file beside its project's totals.

    A project without such files has one row with null ``list`` and ``path``.
    The lists stay rows, so no project's files are gathered.
    """
    listed = with_file_attrs(files).where(structure_scope(F.col("rel_path")))
    kinds = F.filter(F.array(F.when(F.col("is_main"), F.lit("main")), F.when(F.col("is_config"), F.lit("config"))), lambda k: k.isNotNull())
    rows = listed.select("project_id", F.explode(kinds).alias("list"), F.col("rel_path").alias("path"))
    return structure(files).select("project_id", "total_files", "total_size").join(rows, "project_id", "left")


def project_type(files: DataFrame) -> DataFrame:
    """AGG_PROJECT_TYPE: type of the lexically first root config file among six (lower-cased base name)."""
    tmap = dict(C.PROJECT_TYPES)
    f = with_file_attrs(files).where(~F.col("rel_path").contains("/") & F.col("name_l").isin(list(tmap)))
    first = f.groupBy("project_id").agg(F.min_by(map_lookup(tmap, F.col("name_l")), F.col("rel_path")).alias("t"))
    projects = files.select("project_id").distinct()
    return projects.join(first, "project_id", "left").select(
        "project_id", F.coalesce("t", F.lit("unknown")).alias("project_type"))


def detected_languages(files: DataFrame) -> DataFrame:
    """AGG_LANGUAGES: per project and language: files, lines, main files, has_tests, has_linting."""
    f = files.where(language_scope(F.col("rel_path")))
    lang = map_lookup(ext_language_map(), file_ext(F.col("rel_path")))
    main_map = F.create_map(*[x for k, v in LANGUAGE_MAIN_FILES.items()
                              for x in (F.lit(k), F.array(*[F.lit(m.lower()) for m in v]))])
    _, split_lines = line_counts(F.col("content"))
    by_ext = (f.withColumn("language", lang).where(F.col("language").isNotNull())
              .withColumn("_main", F.array_contains(F.try_element_at(main_map, F.col("language")),
                                                    F.lower(basename(F.col("rel_path")))))
              .groupBy("project_id", "language").agg(
                  F.count(F.lit(1)).cast("bigint").alias("files"),
                  F.sum(split_lines).cast("bigint").alias("lines"),
                  F.count_if("_main").cast("bigint").alias("main_files")))
    by_cfg = config_languages(f)
    tests = has_tests(files)
    return (by_ext.join(by_cfg, ["project_id", "language"], "full_outer")
            .select("project_id", "language",
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files", "lines", "main_files", "config_files")],
                    F.coalesce("has_linting", F.lit(False)).alias("has_linting"))
            .join(tests, "project_id", "left"))


def config_languages(files: DataFrame) -> DataFrame:
    """JOIN_CONFIG_LANG + JOIN_LINT_SETUP per (project, language): config files found by base name,
    and linting when a lint tool name of the language is inside one of those config paths."""
    cfg_map = {c.lower(): k for k, _, _, cfgs, _ in LANGUAGES for c in cfgs}
    tools = F.create_map(*[x for k, _, _, _, t in LANGUAGES for x in (F.lit(k), F.array(*[F.lit(s.lower()) for s in t]))])
    path = F.lower(F.col("rel_path"))
    c = (files.withColumn("language", map_lookup(cfg_map, F.lower(basename(F.col("rel_path")))))
         .where(F.col("language").isNotNull())
         .withColumn("_lint", F.exists(F.try_element_at(tools, F.col("language")), lambda t: path.contains(t))))
    return c.groupBy("project_id", "language").agg(F.count(F.lit(1)).cast("bigint").alias("config_files"),
                                                   F.max("_lint").alias("has_linting"))


def has_tests(files: DataFrame) -> DataFrame:
    """JOIN_HAS_TESTS: one flag per project: any path element whose lower name contains a test pattern."""
    parts = F.split(F.lower(F.col("rel_path")), "/")
    hit = F.exists(parts, lambda s: _contains_any(s, TEST_PATTERNS))
    return files.groupBy("project_id").agg(F.max(hit).alias("has_tests"))


def _contains_any(s: Column, pats) -> Column:
    out = F.lit(False)
    for p in pats:
        out = out | s.contains(p)
    return out


def primary_language(langs: DataFrame) -> DataFrame:
    """AGG_PRIMARY: language with most files (ties: first by name); one row per project in ``langs``.

    ``langs`` holds one row per (project, language), so the window sorts at
    most a handful of rows per project.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("project_id").orderBy(F.col("files").desc(), F.col("language"))
    return (langs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("project_id", F.when(F.col("files") > 0, F.col("language")).otherwise(F.lit("unknown"))
                    .alias("primary_language"), F.col("files").alias("primary_files")))


def todo_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of code files (13 extensions, no pruning) with project and path."""
    from codelens.operators.rules import attach
    code = files.where(file_ext(F.col("rel_path")).isin(C.CODE_EXTS))
    return attach(lines, code, cols=("project_id", "rel_path"))


def search(files: DataFrame, todos: DataFrame, errors: DataFrame, q: str) -> DataFrame:
    """FLT_SEARCH: case-insensitive substring over file names, todo messages, error messages (tagged, ranked)."""
    ql = q.lower()
    f = (files.where(structure_scope(F.col("rel_path")) & F.lower("rel_path").contains(ql))
         .select(F.lit("file").alias("kind"), F.lit(1).alias("rank"), "project_id", F.col("rel_path").alias("path"),
                 F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("string").alias("message")))
    t = (todos.where(F.lower("message").contains(ql))
         .select(F.lit("todo").alias("kind"), F.lit(2).alias("rank"), "project_id", F.col("rel_path").alias("path"),
                 F.col("line_no").cast("bigint").alias("line"), "message"))
    e = (errors.where(F.lower("message").contains(ql))
         .select(F.lit("error").alias("kind"), F.lit(3).alias("rank"), "project_id", F.col("file").alias("path"),
                 F.col("line_number").cast("bigint").alias("line"), "message"))
    return f.unionByName(t).unionByName(e)
