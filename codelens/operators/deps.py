"""Dependency manifests to rows.

JSON manifests are parsed with ``from_json`` into typed maps and exploded;
line-oriented manifests (go.mod, requirements.txt, pyproject.toml, Pipfile)
are projections over their lines, with section state forward-filled over
line numbers (bucketed, so one huge manifest is still parallel). ``keys`` name
the manifest a line belongs to; an open section ends with its manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions.text import extract, fields, map_lookup, trim_ws
from codelens.functions.windows import LINE_SPAN, ffill

# ---- FIXED VALUES: manifest name -> language (others: unknown) ----
SOURCE_LANGUAGE = {
    "package.json": "javascript", "go.mod": "go", "requirements.txt": "python", "Cargo.toml": "rust",
    "pom.xml": "java", "composer.json": "php", "Gemfile": "ruby",
}
# ---- FIXED VALUES: dependencies that need a type package ----
TYPES_NEEDED = {
    "node": "@types/node", "express": "@types/express", "lodash": "@types/lodash",
    "react": "@types/react", "jest": "@types/jest",
}
# ---- FIXED VALUES: npm frameworks (dependency, name, language, port, dev, build, test) ----
NPM_FRAMEWORKS = [
    ("react", "React", "javascript", 3000, "npm start", "npm run build", "npm test"),
    ("vue", "Vue.js", "javascript", 8080, "npm run serve", "npm run build", "npm test"),
    ("angular", "Angular", "typescript", 4200, "ng serve", "ng build", "ng test"),
    ("express", "Express", "javascript", 3000, "npm start", "npm run build", "npm test"),
    ("next", "Next.js", "javascript", 3000, "npm run dev", "npm run build", "npm test"),
    ("nuxt", "Nuxt.js", "javascript", 3000, "npm run dev", "npm run build", "npm test"),
]
# ---- FIXED VALUES: substring frameworks of Python and Go manifests ----
PY_FRAMEWORKS = [
    ("django", "Django", "python", 8000, "python manage.py runserver", "", "python manage.py test"),
    ("flask", "Flask", "python", 5000, "flask run", "", "python -m pytest"),
    ("fastapi", "FastAPI", "python", 8000, "uvicorn main:app --reload", "", "python -m pytest"),
]
GO_FRAMEWORKS = [
    ("gin", "Gin", "go", 8080, "go run main.go", "go build", "go test ./..."),
    ("echo", "Echo", "go", 8080, "go run main.go", "go build", "go test ./..."),
    ("fiber", "Fiber", "go", 3000, "go run main.go", "go build", "go test ./..."),
]

# ---- FIXED VALUES: frameworks named in Maven, Composer and Bundler manifests ----
MAVEN_FRAMEWORKS = [
    ("spring-boot", "Spring Boot", "java", 8080, "mvn spring-boot:run", "mvn package", "mvn test"),
    ("quarkus", "Quarkus", "java", 8080, "mvn quarkus:dev", "mvn package", "mvn test"),
]
COMPOSER_FRAMEWORKS = [
    ("laravel", "Laravel", "php", 8000, "php artisan serve", "", "php artisan test"),
    ("symfony", "Symfony", "php", 8000, "symfony server:start", "", "php bin/phpunit"),
]
GEM_FRAMEWORKS = [
    ("rails", "Ruby on Rails", "ruby", 3000, "rails server", "", "rails test"),
    ("sinatra", "Sinatra", "ruby", 4567, "ruby app.rb", "", "ruby test.rb"),
]
#: The frameworks to look for in each manifest that is read as text.
TEXT_MANIFESTS = {"requirements.txt": PY_FRAMEWORKS, "go.mod": GO_FRAMEWORKS, "pom.xml": MAVEN_FRAMEWORKS,
                  "composer.json": COMPOSER_FRAMEWORKS, "Gemfile": GEM_FRAMEWORKS}

MANIFEST_SCHEMA = ("struct<name:string,version:string,scripts:map<string,string>,"
                   "dependencies:map<string,string>,devDependencies:map<string,string>>")
DEP_COLS = ["name", "version", "type", "source"]


def parse_manifest(manifests: DataFrame, content: str = "content") -> DataFrame:
    """SRC_MANIFEST: package.json text -> typed struct column ``pkg`` (NULL when not JSON)."""
    return manifests.withColumn("pkg", F.from_json(F.col(content), MANIFEST_SCHEMA))


def npm_dependencies(manifests: DataFrame, keys=("project_id",)) -> DataFrame:
    """DEP_NPM: dependencies -> direct, devDependencies -> dev."""
    p = parse_manifest(manifests)
    direct = p.select(*keys, F.explode("pkg.dependencies").alias("name", "version"), F.lit("direct").alias("type"))
    dev = p.select(*keys, F.explode("pkg.devDependencies").alias("name", "version"), F.lit("dev").alias("type"))
    return direct.unionByName(dev).withColumn("source", F.lit("package.json"))


def ts_relabel(deps: DataFrame) -> DataFrame:
    """DEP_TS_TYPES: ``@types/*`` -> types, ``typescript`` -> compiler."""
    t = (F.when(F.col("name").startswith("@types/"), "types")
         .when(F.col("name") == "typescript", "compiler").otherwise(F.col("type")))
    return deps.withColumn("type", t)


def merged_dependencies(manifests: DataFrame, keys=("project_id",)) -> DataFrame:
    """SET_MERGE_MAPS: production and dev maps merged per project, dev wins on a shared name."""
    d = npm_dependencies(manifests, keys).withColumn("_dev", (F.col("type") == "dev").cast("int"))
    return (d.groupBy(*keys, "name")
            .agg(F.max_by("version", "_dev").alias("version"), F.max("_dev").cast("boolean").alias("from_dev")))


def missing_type_packages(manifests: DataFrame, keys=("project_id",)) -> DataFrame:
    """JOIN_MISSING_TYPES: direct dependency needing ``@types/x`` that no dependency provides."""
    deps = npm_dependencies(manifests, keys)
    need = (deps.where(F.col("type") == "direct")
            .withColumn("type_package", map_lookup(TYPES_NEEDED, F.col("name")))
            .where(F.col("type_package").isNotNull()))
    have = deps.select(*keys, F.col("name").alias("type_package"))
    return (need.join(have, [*keys, "type_package"], "left_anti")
            .select(*keys, F.col("name").alias("dependency"), "type_package",
                    F.format_string("Missing type definitions for '%s'. Consider installing '%s'",
                                    F.col("name"), F.col("type_package")).alias("message")))


def npm_frameworks(manifests: DataFrame, keys=("project_id",)) -> DataFrame:
    """DEP_FRAMEWORKS (npm): frameworks named exactly by a (merged) dependency."""
    merged = merged_dependencies(manifests, keys)
    dim = F.create_map(*[x for fw in NPM_FRAMEWORKS for x in (F.lit(fw[0]), F.struct(
        F.lit(fw[1]).alias("framework"), F.lit(fw[2]).alias("language"), F.lit(fw[3]).cast("bigint").alias("port"),
        F.lit(fw[4]).alias("dev_command"), F.lit(fw[5]).alias("build_command"), F.lit(fw[6]).alias("test_command")))])
    return (merged.withColumn("_f", F.try_element_at(dim, F.col("name"))).where(F.col("_f").isNotNull())
            .select(*keys, "_f.*", "version"))


def substring_frameworks(lines: DataFrame, catalog, config_file: str, keys=("project_id",)) -> DataFrame:
    """DEP_FRAMEWORKS (pip/go): a framework is present when its name is a substring of the lower-cased manifest."""
    low = F.lower(F.col("line"))
    present = lines.groupBy(*keys).agg(*[F.max(low.contains(fw[0])).alias(f"_{i}") for i, fw in enumerate(catalog)])
    rows = F.array(*[F.when(F.col(f"_{i}"), F.struct(
        F.lit(fw[1]).alias("framework"), F.lit(fw[2]).alias("language"), F.lit(fw[3]).cast("bigint").alias("port"),
        F.lit(fw[4]).alias("dev_command"))) for i, fw in enumerate(catalog)])
    return (present.select(*keys, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_f"))
            .select(*keys, "_f.*", F.lit(config_file).alias("config_file")))


def manifest_frameworks(lines: DataFrame, keys=("project_id",)) -> DataFrame:
    """DEP_FRAMEWORKS (text manifests): frameworks whose name is in a lower-cased line of (keys, config_file, line)."""
    hits = []
    for config_file, catalog in TEXT_MANIFESTS.items():
        hits += [F.when((F.col("config_file") == config_file) & F.lower("line").contains(name), F.struct(
            F.lit(fw).alias("framework"), F.lit(language).alias("language"), F.lit(port).cast("bigint").alias("port"), F.lit(dev).alias("dev_command")))
            for name, fw, language, port, dev, _, _ in catalog]
    found = lines.select(*keys, "config_file", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_f"))
    return found.select(*keys, "_f.*", "config_file").distinct()


def gomod_dependencies(lines: DataFrame, keys=("project_id",), pos: str = "line_no") -> DataFrame:
    """DEP_GOMOD: ``require name ver`` lines and the entries of ``require ( ... )`` blocks."""
    keys = list(keys)
    t = trim_ws(F.col("line"))
    marked = lines.withColumn("_t", t).withColumn(
        "_m", F.when(F.col("_t") == "require (", 1).when(F.col("_t") == ")", 0))
    filled = ffill(marked, keys, pos, "_m", "_in", inclusive=False, span=LINE_SPAN)
    f = fields(F.col("_t"))
    single = F.col("_t").startswith("require ") & (F.col("_t") != "require (") & (F.size(f) >= 3)
    in_block = ((F.col("_in") == 1) & (F.col("_t") != "") & ~F.col("_t").startswith("//")
                & (F.col("_t") != ")") & (F.col("_t") != "require (") & (F.size(f) >= 2))
    name = F.when(single, F.element_at(f, 2)).when(in_block, F.element_at(f, 1))
    ver = F.when(single, F.element_at(f, 3)).when(in_block, F.element_at(f, 2))
    return (filled.where(single | in_block)
            .select(*keys, pos, name.alias("name"), ver.alias("version"), F.lit("direct").alias("type"),
                    F.lit("go.mod").alias("source")))


def requirements_dependencies(lines: DataFrame) -> DataFrame:
    """DEP_REQUIREMENTS: ``name op version``; no operator -> latest; blank and # lines skipped."""
    t = trim_ws(F.col("line"))
    pat = r"([^=<>!]+)[=<>!]+(.+)"
    hit = extract(t, pat, 1).isNotNull()
    return (lines.withColumn("_t", t).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
            .select("*", F.when(hit, trim_ws(extract(t, pat, 1))).otherwise(F.col("_t")).alias("name"),
                    F.when(hit, trim_ws(extract(t, pat, 2))).otherwise(F.lit("latest")).alias("version"),
                    F.lit("direct").alias("type"), F.lit("requirements.txt").alias("source"))
            .drop("_t"))


def section_headers(lines: DataFrame, keys=("project_id",), pos: str = "line_no") -> DataFrame:
    """Each line with its trimmed text ``_t`` and the last ``[...]`` header strictly before it (``_sec``)."""
    marked = (lines.withColumn("_t", trim_ws(F.col("line")))
              .withColumn("_h", F.when(F.col("_t").startswith("["), F.col("_t"))))
    return ffill(marked, list(keys), pos, "_h", "_sec", inclusive=False, span=LINE_SPAN)


def section_dependencies(lines: DataFrame, headers: list[str], source: str, keys=("project_id",), pos: str = "line_no") -> DataFrame:
    """DEP_PYPROJECT / DEP_PIPFILE: ``k = v`` lines inside the given TOML sections.

    A line is inside a section when the last ``[...]`` line before it is one of
    ``headers``; that header is forward-filled once, so parsing several
    section kinds of one file shares the same (reused) plan.
    """
    keys = list(keys)
    filled = section_headers(lines, keys, pos)
    parts = F.split(F.col("_t"), "=")
    keep = F.col("_sec").isin(headers) & ~F.col("_t").startswith("[") & F.col("_t").contains("=")
    return (filled.where(keep)
            .select(*keys, pos, trim_ws(F.element_at(parts, 1)).alias("name"),
                    F.btrim(trim_ws(F.element_at(parts, 2)), F.lit("\"'")).alias("version"),
                    F.lit("direct").alias("type"), F.lit(source).alias("source")))


def package_manager_output(lines: DataFrame) -> DataFrame:
    """DEP_PM_OUTPUT: npm ``a@b``, pip ``a==b``, go ``a b`` list output, by the ``pm`` column."""
    t = trim_ws(F.col("line"))
    at = F.split(t, "@")
    eq = F.split(t, "==")
    f = fields(t)
    pm = F.col("pm")
    ok = ((pm == "npm") & t.contains("@") & (F.size(at) >= 2)) | \
         ((pm == "pip") & t.contains("==") & (F.size(eq) == 2)) | \
         ((pm == "go") & ~t.startswith("go.mod") & (t != "") & (F.size(f) >= 2))
    name = (F.when(pm == "npm", trim_ws(F.element_at(at, 1))).when(pm == "pip", trim_ws(F.element_at(eq, 1)))
            .otherwise(F.element_at(f, 1)))
    ver = (F.when(pm == "npm", trim_ws(F.element_at(at, 2))).when(pm == "pip", trim_ws(F.element_at(eq, 2)))
           .otherwise(F.element_at(f, 2)))
    src = F.when(pm == "go", "go.mod").otherwise(pm)
    return lines.where((t != "") & ok).select("*", name.alias("name"), ver.alias("version"),
                                              F.lit("direct").alias("type"), src.alias("source"))


def dependency_language(source: Column) -> Column:
    """PRJ_DEP_LANGUAGE: manifest name -> language (unknown otherwise)."""
    return map_lookup(SOURCE_LANGUAGE, source, "unknown")


def package_manager(lock_files: DataFrame, keys=("project_id",)) -> DataFrame:
    """DEP_PKG_MANAGER: yarn > pnpm > bun by a root lock file, else npm."""
    prio = F.when(F.col("name") == "yarn.lock", 1).when(F.col("name") == "pnpm-lock.yaml", 2) \
        .when(F.col("name") == "bun.lockb", 3)
    mgr = F.when(F.col("name") == "yarn.lock", "yarn").when(F.col("name") == "pnpm-lock.yaml", "pnpm") \
        .when(F.col("name") == "bun.lockb", "bun")
    return (lock_files.withColumn("_p", prio).withColumn("_m", mgr)
            .groupBy(*keys).agg(F.min_by("_m", "_p").alias("_m"))
            .select(*keys, F.coalesce("_m", F.lit("npm")).alias("package_manager")))
