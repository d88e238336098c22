"""Test-input views derived from the driver tables (see FIXTURES.md).

Each view is a pair of SQL texts, one for Spark SQL and one for DuckDB (most are
the same text). ``register`` makes the Spark views; ``duckdb_with`` builds the
``WITH`` prefix the oracle SQL starts with. The views only derive columns; they
never drop rows of the tables they read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from codelens.session import TABLES

# name -> (spark sql, duckdb sql or None when equal, views it reads)
VIEWS: dict[str, tuple[str, str | None, tuple[str, ...]]] = {}


def _view(name: str, spark_sql: str, duck_sql: str | None = None, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (spark_sql.strip(), duck_sql.strip() if duck_sql else None, deps)


_view("files", """
SELECT doc_id AS file_id, source AS project_id,
       concat(dir, '/f', cast(doc_id AS string), ext) AS rel_path, dir, ext, text AS content
FROM documents
JOIN (VALUES (0,'src'),(1,'tests'),(2,'docs'),(3,'node_modules/pkg'),(4,'lib'),(5,'.hidden'),(6,'config')) AS d(dk, dir)
  ON doc_id % 7 = dk
JOIN (VALUES (0,'.go'),(1,'.py'),(2,'.js'),(3,'.ts'),(4,'.java'),(5,'.cpp'),(6,'.cs'),(7,'.php'),(8,'.rb'),(9,'.rs'),(10,'.md')) AS e(ek, ext)
  ON doc_id % 11 = ek
UNION ALL
SELECT -1 - s_suppkey AS file_id, concat('src', cast(s_suppkey % 20 AS string)) AS project_id, cfg AS rel_path, cdir AS dir,
       cext AS ext, CASE WHEN cfg = 'package.json' THEN concat('{"name":"svc', cast(s_suppkey AS string), '"}') ELSE '' END AS content
FROM supplier
JOIN (VALUES (0,'package.json','','.json'),(1,'go.mod','','.mod'),(2,'.eslintrc.json','','.json'),(3,'tsconfig.json','','.json'),
             (4,'requirements.txt','','.txt'),(5,'Cargo.toml','','.toml'),(6,'tools/flake8/setup.cfg','tools/flake8','.cfg'),
             (7,'yarn.lock','','.lock'),(8,'pnpm-lock.yaml','','.yaml'),(9,'bun.lockb','','.lockb'))
  AS c(ck, cfg, cdir, cext)
  ON s_suppkey % 10 = ck
""")

# One template line per rule the scanners must hit.
_view("line_templates", """
SELECT slot, tpl FROM (VALUES
 (0,'// TODO: handle empty input'),(1,'x = 1  # fixme later'),(2,'    panic("boom")'),
 (3,'for i := 0; i < n; i++ {'),(4,'if err != nil {'),(5,'}'),(6,'password = "hunter2"'),
 (7,'eval(code)'),(8,'el.innerHTML = html'),(9,'s += "abc"'),(10,'fmt.Println(x)'),
 (11,'func Run(a int) error {'),(12,'query = sql + name'),(13,'from ..pkg import x'),
 (14,'except:'),(15,'import os'),(16,'exec(cmd)'),(17,'if x == True:'),(18,'var y = 1 '),
 (19,'NOTE HACK both words'),(20,'[tool.poetry.dependencies]'),(21,'case 1:')) AS t(slot, tpl)
""")

# every line of the document, then template lines after them: up to 30, and 520 in two documents of 97
# (in one of these a single long function)
_view("file_lines", """
SELECT doc_id AS file_id, pos + 1 AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, chr(10))) x AS pos, line
UNION ALL
SELECT a.doc_id, a.n_lines + a.j + 1, t.tpl
FROM (SELECT doc_id, size(split(text, chr(10))) AS n_lines, j FROM documents
      LATERAL VIEW explode(CASE WHEN doc_id % 97 IN (5, 11) THEN sequence(0, 519) WHEN doc_id % 31 = 0 THEN array()
                           ELSE sequence(0, cast(doc_id % 31 AS int) - 1) END) y AS j) a
JOIN line_templates t ON t.slot = CASE WHEN a.doc_id % 97 <> 11 THEN (a.doc_id * 5 + a.j * a.j + a.j % 3 * 4) % 22 WHEN a.j = 0 THEN 11 WHEN a.j = 519 THEN 5
  WHEN a.j % 4 = 0 THEN 3 WHEN a.j % 4 = 1 THEN 6 WHEN a.j % 4 = 2 THEN 10 ELSE 21 END
""", """
SELECT doc_id AS file_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
UNION ALL
SELECT a.doc_id, a.n_lines + a.j + 1, t.tpl
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines,
             unnest(range(0, CASE WHEN doc_id % 97 IN (5, 11) THEN 520 ELSE doc_id % 31 END)) AS j FROM documents) a
JOIN line_templates t ON t.slot = CASE WHEN a.doc_id % 97 <> 11 THEN (a.doc_id * 5 + a.j * a.j + a.j % 3 * 4) % 22 WHEN a.j = 0 THEN 11 WHEN a.j = 519 THEN 5
  WHEN a.j % 4 = 0 THEN 3 WHEN a.j % 4 = 1 THEN 6 WHEN a.j % 4 = 2 THEN 10 ELSE 21 END
""", deps=("line_templates",))

_view("log_lines", """
SELECT event_id AS seq, user_id AS pid, ts,
       CASE WHEN event_id % 3 = 0 THEN 'stderr' ELSE 'stdout' END AS source, msg AS line
FROM events JOIN (VALUES
 (0,'server listening on port 3000'),(1,'TypeError: x is not a function'),(2,'compiled successfully'),
 (3,'WARNING: failed to parse config'),(4,'panic: runtime error'),(5,'GET /index 200'),
 (6,'Traceback (most recent call last)'),(7,'FAIL pkg/foo 0.1s'),(8,'AssertionError in spec'),
 (9,'listen EADDRINUSE :::3000'),(10,'Module not found: react'),(11,'ok pkg/bar'),
 (12,'Fatal exception in test runner'),(13,'connect ECONNREFUSED 10.0.0.1'),(14,'done in 3s'),
 (15,'undefined: foo'),(16,'SyntaxError: bad token'),(17,'cache warm'),(18,'Failed to compile'),
 (19,'npm WARN deprecated'),(20,'Error: expect(x)'),(21,'heartbeat'),(22,'Connection refused')) AS m(slot, msg)
  ON event_id % 23 = slot
""")

_view("file_observations", """
SELECT event_id AS seq, concat('proj', cast(user_id % 20 AS string), '/f', cast(user_id AS string), '.go') AS path,
       ts AS observed_at, date_trunc('day', ts) AS mtime
FROM events
""")

# project_id added to the survey text so diagnostics roll up per project
_view("tool_output", """
SELECT o_orderkey AS seq, o_custkey % 20 AS project_id, tool, CASE tool
  WHEN 'tsc'    THEN concat('src/f', cast(o_custkey % 100 AS string), '.ts(', cast(o_custkey AS string), ',', cast(o_orderkey % 80 AS string), '): error TS', cast(2000 + o_orderkey % 500 AS string), ': Cannot find module x')
  WHEN 'go'     THEN concat('pkg/f', cast(o_custkey % 100 AS string), '.go:', cast(o_custkey AS string), ':', cast(o_orderkey % 80 AS string), ': undefined: error foo')
  WHEN 'flake8' THEN concat('./f', cast(o_custkey % 100 AS string), '.py:', cast(o_custkey AS string), ':', cast(o_orderkey % 80 AS string), ': E501 line too long')
  WHEN 'mypy'   THEN concat('f', cast(o_custkey % 100 AS string), '.py:', cast(o_custkey AS string), ': note: see docs')
  WHEN 'javac'  THEN concat('A', cast(o_custkey % 100 AS string), '.java:', cast(o_custkey AS string), ': error: cannot find symbol')
  WHEN 'unittest' THEN CASE WHEN o_custkey % 4 = 0 THEN 'FAILED (errors=1)' ELSE 'OK' END
  WHEN 'gotest' THEN concat(CASE WHEN o_custkey % 3 = 0 THEN '--- FAIL: Test' ELSE '--- PASS: Test' END, cast(o_custkey AS string))
  WHEN 'jest'   THEN concat('Tests: ', cast(o_custkey % 5 AS string), ' failed, ', cast(o_orderkey % 50 AS string), ' passed, ', cast(o_custkey % 5 + o_orderkey % 50 AS string), ' total')
  ELSE concat('==== ', cast(o_custkey % 5 AS string), ' failed, ', cast(o_orderkey % 50 AS string), ' passed in 0.1s ====') END AS line
FROM orders JOIN (VALUES (0,'tsc'),(1,'go'),(2,'flake8'),(3,'mypy'),(4,'javac'),(5,'gotest'),(6,'jest'),(7,'pytest'),(8,'unittest')) AS t(k, tool)
  ON o_orderkey % 9 = k
""")

_view("manifest_json", """
SELECT s_suppkey AS project_id, concat('{"name":"svc', cast(s_suppkey AS string), '","scripts":{"', CASE WHEN s_suppkey % 2 = 0 THEN 'start' ELSE 'dev' END,
  '":"node ."},"dependencies":{"', fw, '":"^', cast(s_suppkey % 9 AS string), '.0.0","lodash":"4.17.0"},"devDependencies":{"typescript":"5.0.0","@types/', fw, '":"1.0.0"}}') AS content
FROM supplier JOIN (VALUES (0,'react'),(1,'vue'),(2,'express'),(3,'next'),(4,'leftpad')) AS f(k, fw) ON s_suppkey % 5 = k
""")

# manifests read as text, of several projects
_view("framework_manifests", """
SELECT s_suppkey AS project_id, cfg AS config_file, s_suppkey % 9 AS line_no, line FROM supplier JOIN (VALUES
 (0,'requirements.txt','Django==4.2'),(1,'requirements.txt','fastapi>=0.1'),(2,'go.mod','require github.com/gin-gonic/gin v1.9.0'),
 (3,'pom.xml','<artifactId>spring-boot-starter-web</artifactId>'),(4,'pom.xml','<artifactId>quarkus-core</artifactId>'),
 (5,'composer.json','"laravel/framework": "^10"'),(6,'Gemfile','gem "rails", "~> 7"'),(7,'Gemfile','gem "sinatra"'),
 (8,'composer.json','"monolog/monolog": "^3"')) AS m(k, cfg, line) ON s_suppkey % 9 = k
""")

_view("requirement_lines", """
SELECT cast(floor(p_partkey / 100) AS bigint) % 20 AS project_id, p_partkey AS line_no, CASE WHEN p_partkey % 7 = 0 THEN '# comment' WHEN p_partkey % 7 = 1 THEN ''
  ELSE concat('pkg', cast(p_partkey AS string), op, CASE WHEN op = '' THEN '' ELSE concat(cast(p_size AS string), '.0') END) END AS line
FROM part JOIN (VALUES (0,'=='),(1,'>='),(2,'<'),(3,'')) AS o(k, op) ON p_partkey % 4 = k
""")

_view("git_status_lines", """
SELECT p_partkey AS seq, p_partkey % 20 AS project_id, concat(code, ' src/f', cast(p_partkey AS string), '.go') AS line
FROM part JOIN (VALUES (0,'M '),(1,' M'),(2,'MM'),(3,'??'),(4,'A '),(5,'D ')) AS c(k, code) ON p_partkey % 6 = k
""")

_view("ps_lines", """
SELECT c_custkey AS seq, concat('src', cast(c_custkey % 20 AS string)) AS project_id, concat('root ', cast(c_custkey AS string), ' 0.0 0.1 1 1 ? S 10:00 0:00 ', cmd) AS line
FROM customer JOIN (VALUES (0,'node server.js'),(1,'go run main.go'),(2,'python app.py'),(3,'nginx -g daemon'),(4,'/work/proj/run')) AS c(k, cmd) ON c_custkey % 5 = k
""")

_view("listening_ports", "SELECT port FROM (VALUES (3000),(5000),(8080),(4200)) AS p(port)")

_view("snapshots", """
SELECT id AS snapshot_id, CASE WHEN id % 97 = 1 THEN NULL ELSE cast(floor((id + 1) / 3) AS bigint) END AS parent_id,
       o_orderdate AS created_at, o_custkey % 20 AS project_id, cast(floor(o_totalprice) AS bigint) AS size
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderdate, o_custkey, o_totalprice FROM orders) n
""")

_view("investigation_events", """
SELECT event_id AS seq, ts, kind, concat(kind, '_', cast(user_id AS string)) AS entity_id, user_id % 20 AS snapshot_id,
  CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'signup' THEN 'open'
       WHEN kind = 'question' THEN CASE WHEN event_type = 'purchase' THEN 'answered' ELSE 'investigating' END
       WHEN kind = 'hypothesis' THEN CASE WHEN event_type = 'purchase' THEN 'confirmed' WHEN event_type = 'error' THEN 'refuted' ELSE 'active' END
       WHEN kind = 'finding' THEN CASE WHEN event_type = 'purchase' THEN 'verified' ELSE 'open' END
       ELSE CASE WHEN event_type = 'purchase' THEN 'resolved' ELSE 'investigating' END END AS status,
  value / 100.0 AS confidence
FROM events JOIN (VALUES (0,'question'),(1,'hypothesis'),(2,'finding'),(3,'blocker')) AS k(kk, kind) ON user_id % 4 = kk
""")

# every order is a share link (no id subset)
_view("share_links", """
SELECT o_orderkey AS link_id, o_custkey AS snapshot_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 8 END AS max_accesses,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 24 * (o_orderkey % 30) END AS expires_in_hours
FROM orders
""")

_view("link_access", "SELECT event_id, user_id * 7 AS link_id, ts FROM events")

_view("gomod_lines", """
SELECT cast(floor(p_partkey / 100) AS bigint) % 20 AS project_id, p_partkey AS line_no, CASE p_partkey % 6 WHEN 0 THEN 'require (' WHEN 1 THEN concat('  github.com/a/b', cast(p_partkey AS string), ' v1.', cast(p_size AS string), '.0')
  WHEN 2 THEN concat('require github.com/x/y', cast(p_partkey AS string), ' v2.0.', cast(p_size AS string)) WHEN 3 THEN '// pinned v1' WHEN 4 THEN 'module example.com/m'
  ELSE concat('  vitess.io/v', cast(p_partkey AS string), ' v0.', cast(p_size AS string), '.1') END AS line
FROM part
""")

_view("pyproject_lines", """
SELECT cast(floor(p_partkey / 100) AS bigint) % 20 AS project_id, p_partkey AS line_no, CASE p_partkey % 50 WHEN 0 THEN '[tool.poetry.dependencies]' WHEN 15 THEN '[tool.black]' WHEN 25 THEN '[packages]' WHEN 40 THEN '[dev-packages]'
  ELSE concat('pkg', cast(p_partkey AS string), ' = "^', cast(p_size AS string), '.0"') END AS line
FROM part
""")

_view("pm_output", """
SELECT p_partkey AS seq, pm, concat('pkg', cast(p_partkey AS string), sep, cast(p_size AS string), '.0') AS line
FROM part JOIN (VALUES (0,'npm','@'),(1,'pip','=='),(2,'go',' v')) AS m(k, pm, sep) ON p_partkey % 3 = k
""")

_view("lint_json", """
SELECT c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'eslint' ELSE 'tslint' END AS tool,
  CASE WHEN c_custkey % 5 = 0 THEN 'TypeError: linter crashed'
  WHEN c_custkey % 2 = 0 THEN concat('[{"filePath":"src/f', cast(c_custkey AS string), '.js","messages":[{"ruleId":"no-unused-vars","severity":2,"message":"unused","line":', cast(c_nationkey + 1 AS string), ',"column":4},{"ruleId":"semi","severity":1,"message":"semi","line":9,"column":1}]}]')
  ELSE concat('[{"name":"src/f', cast(c_custkey AS string), '.ts","ruleName":"quotes","failure":"quotes","startPosition":{"line":', cast(c_nationkey AS string), ',"character":3}}]') END AS output
FROM customer
""")

# pylint / ruff JSON reports in their public formats, one in five not JSON
_view("python_lint_json", """
SELECT c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'pylint' ELSE 'ruff' END AS tool,
  CASE WHEN c_custkey % 5 = 0 THEN 'NameError: name x is not defined'
  WHEN c_custkey % 2 = 0 THEN concat('[{"type":"error","module":"m', cast(c_custkey AS string), '","obj":"","line":', cast(c_nationkey + 1 AS string), ',"column":0,"path":"app/f', cast(c_custkey AS string), '.py","symbol":"undefined-variable","message":"Undefined variable x","message-id":"E0602"}]')
  ELSE concat('[{"code":"F401","message":"os imported but unused","filename":"app/f', cast(c_custkey AS string), '.py","location":{"row":', cast(c_nationkey AS string), ',"column":1}}]') END AS output
FROM customer
""")

_view("traceback_lines", """
SELECT cast(floor(o_orderkey / 4) AS bigint) AS run_id, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'Traceback (most recent call last):'
  WHEN 1 THEN concat('  File "app/f', cast(o_custkey % 50 AS string), '.py", line ', cast(o_custkey AS string))
  WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN '    x = (1' ELSE concat('    at Module._compile (node:internal/modules:', cast(o_custkey % 90 AS string), ':', cast(o_custkey % 7 AS string), ')') END
  ELSE CASE WHEN o_custkey % 3 = 0 THEN 'IndentationError: unexpected indent' WHEN o_custkey % 3 = 1 THEN 'SyntaxError: invalid syntax' ELSE 'ValueError: no' END END AS line
FROM orders
""")

_view("process_events", """
SELECT event_id AS seq, user_id AS pid, ts, CASE event_type WHEN 'signup' THEN 'start_attempt' WHEN 'error' THEN 'start_failure' WHEN 'click' THEN 'started' WHEN 'view' THEN 'error_line' ELSE 'exited' END AS event
FROM events
""")

_view("process_requests", """
SELECT c_custkey AS req_id, cmd AS command, args FROM customer
JOIN (VALUES (0,'npm','run dev'),(1,'go','run main.go'),(2,'python','app.py'),(3,'rm','x'),(4,'','')) AS r(k, cmd, args) ON c_custkey % 5 = k
""")

_view("tasks", """
SELECT task_id, task FROM (VALUES (1,'Fix login bug'),(2,'Add API endpoint'),(3,'Refactor database layer'),(4,'Write tests for UI'),(5,'Improve docs'),(6,'Implement feature flag')) AS t(task_id, task)
""")

_view("snapshot_files", """
SELECT l_orderkey + 1 AS snapshot_id, concat('src/f', cast(l_linenumber AS string), '.go') AS path, cast(max(floor(l_quantity)) AS bigint) AS line_count
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in TABLES:  # driver tables are views already
            return
        for d in VIEWS[n][2]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


# tables whose rows carry per-row work (text to explode, many rows to scan with regexes)
SPREAD_TABLES = {"documents", "events", "orders", "lineitem", "pages", "conversations"}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver tables and every fixture view as temp views."""
    key = f"codelens.registered::{sf_dir}"
    if spark.conf.get("codelens.registered", "") == key and spark.catalog.tableExists("file_lines"):
        return
    from codelens.sources.tables import read_table

    for t in TABLES:
        read_table(spark, f"{sf_dir}/{t}.parquet", spread_small_splits=t in SPREAD_TABLES).createOrReplaceTempView(t)
    for name in _closure(VIEWS):
        builder = SPARK_BUILDERS.get(name)
        df = builder(spark) if builder else spark.sql(VIEWS[name][0])
        df.createOrReplaceTempView(name)
    spark.conf.set("codelens.registered", key)


def _snapshots_df(spark: SparkSession):
    """``snapshots`` with the id numbered by the bucketed dense index instead of a
    global ``row_number()`` window (which would run in one task); same rows as the SQL text."""
    from pyspark.sql import functions as F

    from codelens.functions.windows import dense_index

    n = dense_index(spark.table("orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice"),
                    [], "o_orderkey", out="id")
    return n.select(
        F.col("id").alias("snapshot_id"),
        F.when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.floor((F.col("id") + 1) / 3).cast("bigint"))
        .alias("parent_id"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 20).alias("project_id"),
        F.floor("o_totalprice").cast("bigint").alias("size"))


SPARK_BUILDERS = {"snapshots": _snapshots_df}


def duckdb_with(views, ctes: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """``WITH`` prefix for DuckDB: the fixture views (with their inputs) then extra CTEs."""
    parts = []
    for name in _closure(views):
        spark_sql, duck_sql, _ = VIEWS[name]
        parts.append(f"{name} AS (\n{duck_sql or spark_sql}\n)")
    for name, body in ctes:
        parts.append(f"{name} AS (\n{body.strip()}\n)")
    if not parts:
        return ""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
