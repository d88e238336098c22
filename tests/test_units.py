"""Unit tests on hand-made rows: skew-safe helpers against brute force, and the source tool's quirks."""

import random

from pyspark.sql import functions as F

from codelens.functions import catalogs as C
from codelens.functions.text import any_of, java_regex
from codelens.functions.windows import dense_index, ffill
from codelens.operators import ops as O
from codelens.operators import process as P
from codelens.operators import rules as R
from codelens.operators import snapshots as S


def test_dense_index_small_buckets_equals_row_number(spark):
    rows = [(k, p) for k in ("hot", "cold") for p in random.Random(1).sample(range(10_000), 700 if k == "hot" else 30)]
    df = spark.createDataFrame(rows, "k string, p long")
    got = {(r.k, r.p): r.idx for r in dense_index(df, ["k"], "p", width=16).collect()}
    for k in ("hot", "cold"):
        ps = sorted(p for kk, p in rows if kk == k)
        assert [got[(k, p)] for p in ps] == list(range(1, len(ps) + 1))


def test_dense_index_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5000)), min_size=1, max_size=300,
                    unique_by=lambda t: t), st.sampled_from([1, 3, 64, 1 << 16]))
    def check(rows, width):
        df = spark.createDataFrame(rows, "k string, p long")
        got = {(r.k, r.p): r.idx for r in dense_index(df, ["k"], "p", width=width).collect()}
        for k in {k for k, _ in rows}:
            ps = sorted(p for kk, p in rows if kk == k)
            assert [got[(k, p)] for p in ps] == list(range(1, len(ps) + 1))

    check()


def test_prefix_sum_small_buckets(spark):
    from codelens.functions.windows import prefix_sum
    rng = random.Random(11)
    rows = [(k, p, rng.randint(1, 9)) for k in ("a", "b") for p in rng.sample(range(2000), 150)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    for inclusive in (True, False):
        got = {(r.k, r.p): r.s for r in prefix_sum(df, ["k"], "p", "v", "s", inclusive=inclusive, width=7).collect()}
        for k in ("a", "b"):
            run = 0
            for _, p, v in sorted(r for r in rows if r[0] == k):
                assert got[(k, p)] == (run + v if inclusive else run)
                run += v


def test_sparse_positions_go_through_levels_of_nodes(spark):
    """Positions far apart: several levels of nodes (small fan-out) give what one ordered pass gives."""
    from codelens.functions.windows import prefix_sum
    rng = random.Random(5)
    rows = [(k, p, rng.randint(1, 9), rng.choice([None, None, "x", "y"]))
            for k, n in (("hot", 400), ("cold", 5)) for p in rng.sample(range(-1000, 1 << 40), n)]
    rows += [("hot", -(1 << 39), 3, None), ("hot", (1 << 40) + 7, 4, "z")]
    df = spark.createDataFrame(rows, "k string, p long, v long, t string").cache()
    shape = {"width": 1 << 8, "span": 1 << 41, "fanout": 1 << 7}
    index = {(r.k, r.p): r.idx for r in dense_index(df, ["k"], "p", **shape).collect()}
    sums = {(r.k, r.p): r.s for r in prefix_sum(df, ["k"], "p", "v", "s", **shape).collect()}
    last = {(r.k, r.p): r.o for r in ffill(df, ["k"], "p", "t", "o", inclusive=False, **shape).collect()}
    for k in ("hot", "cold"):
        run, seen = 0, None
        for n, (_, p, v, t) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1]), 1):
            run += v
            assert (index[k, p], sums[k, p], last[k, p]) == (n, run, seen)
            seen = t or seen
    df.unpersist()


def test_a_million_sparse_positions_of_one_key(spark):
    """No window partition of the plan above the rows holds more than its share of a key's summaries."""
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") >= 0, "hot").alias("k"), (F.col("id") * 4_194_301).alias("p"))  # each in a bucket of its own
    out = dense_index(df, ["k"], "p")
    wrong, rows = out.select(F.count_if(F.col("idx") != F.col("p") / 4_194_301 + 1), F.count(F.lit(1))).first()
    assert (wrong, rows) == (0, n)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    buckets = df.select(F.floor(F.col("p") / (1 << 16)).alias("b"))
    largest = buckets.groupBy(F.floor(F.col("b") / (1 << 18)).alias("up")).count().agg(F.max("count")).first()[0]
    tops = buckets.select(F.floor(F.col("b") / (1 << 18))).distinct().count()
    assert largest <= 1 << 18 and tops <= 1 << 18 and largest < n // 200


def test_parse_duration_minutes(spark):
    df = spark.createDataFrame([("90s",), ("5m",), ("2h",), ("soon",), ("",)], "t string")
    got = [r.m for r in df.select(P.parse_duration_minutes(F.col("t")).alias("m")).collect()]
    assert got == [1.5, 5.0, 120.0, 5.0, 5.0]
    more = [("1h30m", 90.0), ("1.5h", 90.0), ("500ms", 1 / 120), ("-2m", -2.0), ("+.5m", 0.5), ("0", 0.0), ("1h 30m", 5.0), ("5", 5.0), (None, 5.0), ("2.h", 120.0), ("3us", 5e-8)]
    df = spark.createDataFrame([(t,) for t, _ in more], "t string")
    got = [r.m for r in df.select(P.parse_duration_minutes(F.col("t")).alias("m")).collect()]
    assert all(abs(a - b) < 1e-12 for a, (_, b) in zip(got, more, strict=True)), got


def test_user_patterns(spark):
    """Two processes' lines with one seq both stay; a pattern that is no regex is reported, not fatal."""
    from codelens.operators import diagnostics as D
    lines = spark.createDataFrame([(1, 1, "heartbeat"), (1, 2, "heartbeat"), (2, 1, "panic: x"), (3, 3, "quiet")], "seq long, pid long, line string")
    own = spark.createDataFrame([(1, "heart"), (1, "beat$"), (2, "HEART"), (2, "(?i)HEART"), (3, "broken("), (3, "a++")], "pid long, pattern string")
    got = sorted((r.seq, r.pid) for r in D.classify_with_user_patterns(lines, own).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
    assert sorted(r.pattern for r in D.rejected_patterns(own).collect()) == ["a++", "broken("]


def test_needed_strings():
    from codelens.operators.diagnostics import needed_strings
    cases = {"heartbeat|cache warm": ["cache warm", "heartbeat"], "(?i)HEART": ["heart"], r"GET\s/index": ["/index"], "abc(?:lost|gone away)+z": ["gone away", "lost"],
             "a.*b": [], "(?:long word)?end": [], "(?:long word)*ended": ["ended"], "[[:alpha:]]abcd": [], "(?x)ab cd ef": [], "abcd&&efgh": [], "x{3}four\\.": ["four."],
             "caf\u00e9 open": [" open"], "": [], "one|(?:two)": [], "ab(cdef){0,2}ghij": ["ghij"]}
    for pattern, want in cases.items():
        assert needed_strings(pattern) == want, pattern


def test_many_user_patterns_equal_plain_tests(spark):
    """5,000 patterns of one process, searched by strings, give the rows that testing each pattern on each line gives."""
    import re
    from codelens.operators import diagnostics as D
    rng = random.Random(23)
    some = ["disk", "quota", "retry", "SOCKET", "\u017fhort", "\u0131nput", "caf\u00e9", "\U0001f600ok", "cache", "warm", "tick"]
    rows = [(i, rng.choice([1, 1, 2, 3]), " ".join(rng.choice(some) for _ in range(rng.randint(0, 5))) + f" v{rng.randint(0, 60)}00") for i in range(300)]
    rows += [(i, 1, "disk quota v700") for i in range(300, 340)] + [(400, 1, None), (401, None, "disk quota"), (402, 1, "x" * 30_000 + " needle77"), (403, 4, "needle77")]
    lines = spark.createDataFrame(rows, "seq long, pid long, line string")
    kinds = ["disk quota", "(?i)socket v", "retry (?:warm|tick) v", "(?i)short", "(?i)input (disk|cache)", "v1[0-9]00$", "^tick", "needle77", "caf\u00e9 v2", "broken("]
    own = [(1, p) for p in kinds] + [(1, f"unseen {i} thing") for i in range(5000)] + [(2, "tick v"), (2, "cache disk"), (4, "(?:needle)?77"), (None, "disk")]
    udf = spark.createDataFrame(own, "pid long, pattern string")
    got = sorted(r.seq for r in D.classify_with_user_patterns(lines, udf).collect())
    # the characters that fold to ASCII letters are taken by the JVM's rule, which Python's re shares for these
    gate = [re.compile(p) for p in C.PROCESS_ERROR_PATTERNS]
    mine = {}
    for pid, p in own:
        if pid is not None and p != "broken(":
            mine.setdefault(pid, []).append(re.compile(p))
    want = sorted(s for s, pid, t in rows if t is not None and any(g.search(t) for g in [*gate, *mine.get(pid, [])]))
    assert len(want) > 100 and got == want
    few = sorted(r.seq for r in D.classify_with_user_patterns(lines, udf.where("pattern NOT LIKE 'unseen%'"), few=1000).collect())
    assert few == got
    assert D.classify_with_user_patterns(lines, udf.limit(0)).count() == sum(any(g.search(t) for g in gate) for _, _, t in rows if t is not None)


def test_recent_changes_keep_each_workspace(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"p{i % 3}/f.go", t0 + dt.timedelta(seconds=i)) for i in range(900)]
    df = spark.createDataFrame(rows, "seq long, path string, observed_at timestamp")
    got = P.recent_changes(df, keep=100, minutes=60).groupBy("project").count().collect()
    assert {(r["project"], r["count"]) for r in got} == {("p0", 100), ("p1", 100), ("p2", 100)}


def test_nullsafe_count_if_rewrite():
    from codelens.plans.registry import nullsafe_count_if
    sql = "SELECT count_if(contains(x, 'a)(')) + count_if(y = 'it''s'), my_count_if(z) FROM t"
    assert nullsafe_count_if(sql) == ("SELECT coalesce(count_if(contains(x, 'a)(')), 0) + "
                                      "coalesce(count_if(y = 'it''s'), 0), my_count_if(z) FROM t")


def test_ffill_matches_python(spark):
    rng = random.Random(7)
    rows = [(f, n, rng.choice([None, None, None, n * 10])) for f in range(3) for n in range(1, 400)]
    df = spark.createDataFrame(rows, "f long, n long, v long")
    for inclusive in (True, False):
        got = {(r.f, r.n): r.o for r in ffill(df, ["f"], "n", "v", "o", inclusive=inclusive, width=8).collect()}
        for f in range(3):
            last = None
            for _, n, v in [r for r in rows if r[0] == f]:
                if inclusive and v is not None:
                    last = v
                assert got[(f, n)] == last
                if not inclusive and v is not None:
                    last = v


def test_nested_loops_brute_force(spark):
    rng = random.Random(3)
    lines = [(1, i, "for x" + " " if rng.random() < 0.2 else "y") for i in range(1, 300)]
    lines = [(f, n, ("for " if t.startswith("for") else "x")) for f, n, t in lines]
    df = spark.createDataFrame(lines, "file_id long, line_no long, line string")
    got = {r.line_no for r in R.nested_loops(df).collect()}
    text = {n: t for _, n, t in lines}
    want = {n for n in text if "for " in text[n] and any("for " in text.get(j, "") for j in range(n + 1, n + 10))}
    assert got == want


def test_lineage_brute_force_with_missing_parents(spark):
    rng = random.Random(5)
    nodes = [(1, None)] + [(i, rng.randint(1, i - 1) if rng.random() > 0.05 else 10_000 + i) for i in range(2, 400)]
    df = spark.createDataFrame(nodes, "snapshot_id long, parent_id long")
    got = {r.snapshot_id: list(r.path) for r in S.lineage(df).collect()}
    parent = dict(nodes)
    for n, _ in nodes:
        path, cur = [n], parent[n]
        while cur is not None and cur in parent:
            path.insert(0, cur)
            cur = parent[cur]
        assert got[n] == path


def test_java_regex_matches_re2_semantics(spark):
    df = spark.createDataFrame([("Error: x\r",), ("toKen = 'a'",), ("fine",)], "line string")
    r = df.select(F.regexp_extract("line", java_regex(r"Error: (.+)"), 1).alias("m"),
                  F.col("line").rlike(java_regex(r"(?i)(token)\s*[:=]")).alias("tok")).collect()
    assert r[0].m == "x\r"          # '.' takes the carriage return, as RE2 does
    assert r[1].tok                 # Unicode case folding (KELVIN SIGN ~ k)
    assert any_of([r"(?i)error.*", r"FAIL .+"]) == r"(?i:error.*)|(?:FAIL .+)"


def test_todo_priority_is_list_order(spark):
    df = spark.createDataFrame([(1, 1, "NOTE HACK both words"), (1, 2, "x xxx todo")], "file_id long, line_no long, line string")
    got = {r.line_no: (r.todo_type, r.message) for r in R.todos(df).collect()}
    assert got[1] == ("HACK", "HACK both words")
    assert got[2] == ("TODO", "todo")


def test_git_untracked_falls_into_modified(spark):
    df = spark.createDataFrame([(1, "?? a.go"), (2, "M  b.go"), (3, " M c.go"), (4, "x")], "seq long, line string")
    got = {r.seq: r.category for r in O.git_status_files(df).collect()}
    assert got == {1: "modified", 2: "staged", 3: "modified"}


def test_top_k_hot_group(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = P.top_k(df, ["g"], [F.col("v").desc()], 4).collect()
    assert sorted((r.g, r.v) for r in got) == sorted([("hot", v) for v in (4999, 4998, 4997, 4996)] + [("cold", v) for v in range(3)])


def test_snapshot_update_and_delete(spark):
    snaps = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2"), (3, "c", "d3")], "snapshot_id long, name string, description string")
    upd = spark.createDataFrame([(2, "B", None)], "snapshot_id long, name string, description string")
    tomb = spark.createDataFrame([(3,)], "snapshot_id long")
    from codelens.sinks.store import delete_snapshots, update_snapshots
    out = {r.snapshot_id: (r.name, r.description) for r in delete_snapshots(update_snapshots(snaps, upd), tomb).collect()}
    assert out == {1: ("a", "d1"), 2: ("B", "d2")}


def test_lineage_cycles_and_missing_parents(spark):
    from codelens.operators import snapshots as S
    rows = [(1, 2), (2, 1), (3, None), (4, 3), (5, 1), (6, 6), (7, 99), (8, 7), (9, 6), (10, 4)]
    df = spark.createDataFrame(rows, "snapshot_id long, parent_id long")
    want = {1: None, 2: None, 3: [3], 4: [3, 4], 5: None, 6: None, 7: [7], 8: [7, 8], 9: None, 10: [3, 4, 10]}
    got = {r.snapshot_id: r for r in S.lineage(df).collect()}
    assert {k: r.path for k, r in got.items()} == want
    flat = {r.snapshot_id: r for r in S.lineage(df, with_path=False).collect()}
    for k, p in want.items():
        for r in (got[k], flat[k]):
            assert (r.cyclic, r.depth, r.root_id) == ((True, None, None) if p is None else (False, len(p), p[0]))


def test_lineage_of_a_long_chain(spark):
    from codelens.operators import snapshots as S
    n = 100_000
    df = spark.range(1, n + 1).select(F.col("id").alias("snapshot_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    got = S.lineage(df, with_path=False).agg(F.sum((F.col("depth") == F.col("snapshot_id")).cast("int")), F.max("root_id"), F.max("depth")).first()
    assert tuple(got) == (n, 1, n)


def test_line_analysis_over_blocks(spark, monkeypatch):
    """Neighbours and Go functions that reach over block borders count as in one block."""
    import random

    from codelens.operators import analysis as A
    rng = random.Random(1)
    pool = ["for i := 0; i < n; i++ {", "if err != nil {", "}", "func Run(a int) error {", "x := 1", "case 1:", 'panic("x")', "// TODO: y", "  }"]
    rows = [(f, i + 1, rng.choice(pool)) for f in range(6) for i in range(rng.choice([1, 40, 333]))]
    lines = spark.createDataFrame(rows, "file_id long, line_no int, line string")
    files = spark.createDataFrame([(f, "p", f"src/a{f}.{'go' if f % 2 else 'py'}") for f in range(7)], "file_id long, project_id string, rel_path string")
    whole = sorted(map(tuple, A.file_issue_counts(files, lines).collect()))
    for width in (9, 13, 100):
        monkeypatch.setattr(A, "BLOCK_LINES", width)
        assert sorted(map(tuple, A.file_issue_counts(files, lines).collect())) == whole
    by_file = {f: [l for g, _, l in rows if g == f] for f in range(6)}
    for row in whole:
        texts = by_file.get(row[0], [])
        loops = [i for i, l in enumerate(texts) if "for " in l]
        assert row[-2] == sum(any(0 < j - i <= 9 for j in loops) for i in loops)
        go = row[0] % 2 == 1
        assert row[-3] == go * sum(a == "if err != nil {" and b.strip() == "}" for a, b in zip(texts, texts[1:]))


def test_dev_servers(spark):
    """The last start counts; processes that never started or were refused are not listed; sets of patterns by type."""
    import datetime as dt

    from codelens.operators import ops as O
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    requests = spark.createDataFrame([(1, "npm", "run dev"), (2, "go", "run main.go"), (3, "rm", "x"), (4, "python", "app.py"), (5, "npm", None)], "pid long, command string, args string")
    events = spark.createDataFrame([(1, 1, at(0), "started"), (1, 2, at(5), "exited"), (1, 3, at(9), "started"), (1, 4, at(20), "error_line"), (2, 5, at(1), "started"),
                                    (2, 6, at(2), "exited"), (3, 7, at(0), "started"), (4, 8, at(3), "exited"), (5, 9, at(30), "started")], "pid long, seq long, ts timestamp, event string")
    got = {r.name: (r.status, r.start_time, r.uptime_seconds) for r in O.dev_servers(requests, events, events.select(F.max("ts")).scalar()).collect()}
    assert got == {"npm/next/vite_1": ("running", at(9), 21), "go_2": ("stopped", at(1), 29), "unknown_5": ("running", at(30), 0)}
    kinds = spark.createDataFrame([(1, "vite"), (2, "go"), (3, "other"), (4, None)], "pid long, kind string")
    pats = sorted(map(tuple, O.dev_server_patterns(kinds).collect()))
    assert pats == [(1, "Error:"), (1, "Failed to compile"), (1, "Module not found"), (2, "cannot find package"), (2, "fatal error:"), (2, "panic:")]


def test_error_overlap_by_grams_equals_broadcast(spark):
    """Words joined by their rarest gram give the files that a broadcast of the words gives, and those of a plain test."""
    from codelens.operators import suggest as SG
    rng = random.Random(17)
    letters = "abcd\u00e9\U0001f600"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    lines = [(i % 40, f"p{i % 3}", i, " ".join(piece(rng.randint(1, 7)) for _ in range(rng.randint(0, 6)))) for i in range(400)]
    lines += [(90, "p0", 900, None), (91, None, 901, "abcdabcd"), (92, "p0", 902, "x" * 50_000 + "aaaa" + "NULL"), (93, "p9", 903, "abcd")]
    errors = [("p0", 1, "aaaa nullx " + piece(5)), ("p0", 2, " ".join(piece(4) for _ in range(5))), ("p1", 1, "abc " + piece(4) + " " + piece(9)),
              ("p2", 4, None), ("p2", 5, piece(4)), ("p2", 6, ""), ("p2", 7, "abcd"), (None, 1, "abcdabcd")]
    ldf = spark.createDataFrame(lines, "file_id long, project_id string, line_no long, line string")
    edf = spark.createDataFrame(errors, "project_id string, seq long, message string")
    first = {}
    for p, _, m in sorted((e for e in errors if e[0] is not None), key=lambda e: e[:2]):
        first.setdefault(p, []).append(m)
    want = {(f, p) for f, p, _, text in lines for m in first.get(p, [])[:3] if m and text for w in m.lower().split(" ") if len(w) > 3 and w in text.lower()}
    assert len(want) > 5
    for small in (1000, 0):
        got = SG.error_overlap(ldf, edf, small=small)
        assert {(r.file_id, r.project_id) for r in got.collect()} == want, small
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    none = SG.error_overlap(ldf.limit(0), edf.limit(0), small=0)
    assert none.collect() == []


def test_shared_pattern_lists(spark):
    """Lists of patterns that processes share give what each process's own patterns give, and stay as many rows as the lists have."""
    from codelens.operators import diagnostics as D
    lines = spark.createDataFrame([(i, i % 40, f"heartbeat {i % 90} of node {i % 7}" if i % 5 else None) for i in range(600)], "seq long, pid long, line string")
    lists = [(k, p) for k in range(3) for p in [*(f"beat {k}{j} of" for j in range(9)), *(f"unseen {k} {j}" for j in range(20)), "node 6", "broken("]]
    lists += [(7, "beat 8")]  # of a process that has two lists
    members = [(p, p % 4) for p in range(40)] + [(3, 7), (0, 7), (None, 0)]
    shared = spark.createDataFrame(lists, "list long, pattern string"), spark.createDataFrame(members, "pid long, list long")
    own = shared[1].join(shared[0], "list").select("pid", "pattern").distinct()
    want = sorted(r.seq for r in D.classify_with_user_patterns(lines, own).collect())
    got = D.classify_with_user_patterns(lines, shared[0], members=shared[1])
    assert want and sorted(r.seq for r in got.collect()) == want


def test_file_facts_sort_no_text(spark):
    """Lines are hash-aggregated without their files' attributes, a file that comes twice counts its lines twice, and no line is shuffled or sorted."""
    from codelens.operators import suggest as SG
    lines = spark.createDataFrame([(1, 1, "for x in y:"), (1, 2, "  for z in x: print(z)  # TODO"), (1, 3, "except:"), (2, 1, "x" * 121)], "file_id long, line_no long, line string")
    files = spark.createDataFrame([(1, "python"), (2, "go"), (2, "go"), (3, "go")], "file_id long, language string")
    facts = SG.file_facts(lines, files)
    scores = SG.block_scores(facts, lines)
    assert {r.file_id: tuple(r)[1:] for r in scores.collect()} == {1: ("python", 3, 0, 1, 60), 2: ("go", 2, 0, 0, 80)}
    assert {r.file_id: r.n_lines for r in facts.collect()} == {1: 3, 2: 2}
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert not any("line#" in x for x in plan.split("\n") if "Sort [" in x or "Exchange hash" in x)
