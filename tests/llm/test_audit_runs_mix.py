"""Filter audit, periodic runs and mixing against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codelens.llm import filter_audit as A, mixing as M, periodic_runs as R
from codelens.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.helpers import CLASHING, docs, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


# ---- filter audit

def audit_brute(documents, labels):
    """All documents through all orders, one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = Counter()
    parts = {p or "" for _, _, p in documents}
    least = {}
    for i, t, _ in documents:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, p in documents:
        t, p = t or "", p or ""
        w = WORDS.findall(t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and least[t] < i), strict=True) if bad}
        for order in itertools.permutations("ABCDE"):
            alive = True
            for step, f in enumerate(order, 1):
                at = (p, "".join(order), step)
                if f in fails and alive:
                    out[*at, "removed"] += 1
                    out[*at, "good_lost"] += i in good
                    out[*at, "toxic_lost"] += i in toxic
                    out[p, f, "shapley"] += 1
                out[*at, "redundant"] += f in fails and not alive
                out[*at, "unique_fails"] += fails == {f}
                alive = alive and f not in fails
                out[*at, "kept"] += alive
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, "".join(o), k, *(out[p, "".join(o), k, c] for c in names), out[p, f, "shapley"])
                  for p in parts for o in itertools.permutations("ABCDE") for k, f in enumerate(o, 1))


def audit(spark, df, labels, **names):
    return rows(A.interactions(A.mask_cells(df, spark.createDataFrame(labels, LABELS), **names)))


def test_audit(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", "a b", long, long + " &", "A" * 40 + " " + long, " ".join(["x y"] * 150), "é x y " + long, "x\x0by\x0cz \t\n"]
    documents = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice(["s1", "s2", "", None])) for _ in range(120)]
    documents += [(3, long, "s1")] * 4 + [(None, long, "s2")] * 3  # repeated rows, and rows without an id
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(20)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(documents, "doc_id long, text string, source string")
    want = audit_brute(documents, labels)
    assert audit(spark, df, labels) == sorted(want, key=repr)
    extra = df.withColumns({c: F.lit("x") for c in (*CLASHING, "part", "mask", "id", "digest", "good", "n", "deal")})
    assert audit(spark, extra, labels) == sorted(want, key=repr)


def test_audit_groups_of_copies_stay_small(spark):
    """Copies are counted before they meet: one row for each part and mark, however many there are."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    got = A.mask_cells(df, spark.createDataFrame([], LABELS)).collect()
    assert sorted((r.part, r.mask, r.n) for r in got) == [("0", 1, 1), ("0", 17, 999), ("1", 17, 1000), ("2", 17, 1000)]


# ---- periodic runs

def runs_brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_brute(w):
    gone = {i for s, n, q in runs_brute(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plant_brute(w, key):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


pieces = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 12))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=5), max_size=4))
def test_runs(texts):
    texts = [[x for unit, times in t for x in unit * times] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = R.find_runs(np.array([x for t in texts for x in t], np.int64), bounds)
    want = sorted((b + s, b + s + n, q) for t, b in zip(texts, bounds, strict=False) for s, n, q in runs_brute(t))
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want


def test_runs_at_length():
    """Long powers, powers of powers, and the Thue-Morse word, which has no run but defeats hashes modulo 2 ** 64."""
    morse = [bin(i).count("1") % 2 for i in range(1 << 12)]
    cases = [[7] * 5000, [1, 2, 3] * 2000 + [1, 2], ([1] * 9 + [2]) * 300, morse, [*morse[:2048], *([5, 6] * 300), *morse[2048:]], list(range(3000)) * 4]
    for w in cases:
        s, e, q = R.find_runs(np.array(w, np.int64), np.array([0, len(w)]))
        assert sorted(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == runs_brute(w)


def test_grammar_has_no_repeated_pair_left():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randint(0, 4) for _ in range(rng.randint(0, 200))]
        rules, at, rule, where = R.re_pair(np.array(w, np.int64))
        ends = np.append(at[1:], len(w)) if w else at
        left = [tuple(w[a:b]) for a, b in zip(at, ends, strict=True)]
        pairs, last = Counter(), {}
        for i, pair in enumerate(zip(left, left[1:], strict=False)):
            if last.get(pair) != i - 1:  # aaa has one pair that does not overlap itself
                pairs[pair] += 1
                last[pair] = i
        same_text = {k for k, v in pairs.items() if v > 1}
        assert not {p for p in same_text if len(p[0]) == len(p[1]) == 1}
        for r in range(len(rules.start)):
            size = rules.end[r] - rules.start[r]
            places = where[rule == r]
            assert len(places) >= 2 and {tuple(w[p: p + size]) for p in places} == {tuple(w[rules.start[r]: rules.end[r]])}


def test_runs_of_texts(spark):
    texts = [None, "", " \t\x0b ", "a a a a a a", "a a a a a", "x  y\tx y\nx y x y z", "A a A a A a A a", "é é é é é é é", " ".join(["p q r"] * 40), "a b " * 8]
    texts += ["long " + "tail end " * 60_000 + "x"]  # beyond one slice
    df = docs(spark, [*texts, "a a a a a a"], ids=[None, *range(len(texts))], extra=True)
    got = R.with_runs(df)
    assert set(df.columns) <= set(got.columns)
    for r in got.collect():
        w = WORDS.findall(r.text or "")
        assert [tuple(x) for x in r.runs] == runs_brute(w) if len(w) < 1000 else len(r.runs) == 1
        if len(w) < 1000:
            assert r.collapsed == collapsed_brute(w)
        assert r.shard == (None if r.doc_id is None else f"shard of {r.doc_id}")


def test_runs_query(spark):
    got = {r.doc_id: r for r in R.op12_runs(spark, SF_SMALL).collect()}
    documents = table(spark, SF_SMALL, "documents").collect()
    assert len(got) == len(documents)
    with_runs = 0
    for d in documents:
        w = plant_brute(WORDS.findall(d.text or ""), d.doc_id)
        r = got[d.doc_id]
        if len(w) > 1500:
            continue
        runs = runs_brute(w)
        with_runs += bool(runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(collapsed_brute(w)))
    assert with_runs > 5


# ---- mixing

def targets_brute(sizes, weights=(1, 2, 3), times=3):
    """Reshare the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(times * sizes[s] for s in stopped)
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if target[s] >= times * sizes[s]}
        if not above:
            return {s: float(times * sizes[s]) if s in stopped else target[s] for s in order}
        stopped |= above


def mixed(spark, data, **more):
    return M.mix(spark.createDataFrame(data, "doc_id long, source string, size long"), **more).collect()


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "zz", "\U0001f600"][: rng.randint(1, 7)]
    data = [(rng.choice([None, *range(400)]), s, rng.choice([0, rng.randint(1, 9), rng.randint(1, 700)]))
            for s in names for _ in range(rng.choice([1, 5, 300]))] + [(1, names[0], 4)] * 1500
    got = mixed(spark, data)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(data)
    sizes = Counter()
    for _, s, n in data:
        sizes[s] += n
    want = targets_brute(dict(sizes))
    taken, most = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1, most[s] / 2), (s, taken[s], t)
        per = [r.copies for r in got if r.source == s and r.size]
        assert not per or max(per) - min(per) <= 1
    assert rows(M.mix(spark.createDataFrame(data[::-1], "doc_id long, source string, size long").repartition(7))) == sorted(map(tuple, got), key=repr)


def test_nearest_sum():
    rng = random.Random(1)
    for _ in range(300):
        sizes = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 5))))
        free = np.array([rng.randint(0, 4) for _ in sizes])
        want = rng.randint(0, 60)
        sums = {sum(k * int(n) for k, n in zip(ks, sizes, strict=True)) for ks in itertools.product(*[range(f + 1) for f in free])}
        got = M.nearest(sizes, free, want)
        assert (got <= free).all() and (got >= 0).all()
        assert int((got * sizes).sum()) == min((s for s in sums if s <= 2 * want), key=lambda s: (abs(s - want), s))


def test_fit_beyond_the_table():
    """Budgets far above the knapsack table, giants among them, and counts near the limit of 64 bits."""
    sizes, counts = np.array([0, 3, 5, 1000, 3_000_000]), np.array([9, 4000, 10**12, 10**9, 7])
    total = int((sizes * counts).sum())
    for budget in (0, 1, 17, total // 3, total - 8, total, 2 * total + 12345, 3 * total):
        times, extra = M.fit(sizes, counts, budget)
        assert (extra >= 0).all() and (extra <= counts).all()
        assert times * total + int((extra * sizes).sum()) == (budget if budget != 1 else 0)
    times, extra = M.fit(np.array([10_000_000]), np.array([3]), 14_000_000)  # one giant or none: the nearer
    assert (times, extra.tolist()) == (0, [1])


def test_mix_cases(spark):
    assert mixed(spark, []) == []
    assert [tuple(r) for r in mixed(spark, [(1, None, 0), (1, None, 0)])] == [(1, None, 0, 0, 0.0, 0)] * 2
    got = mixed(spark, [(i, "a", 10) for i in range(5000)] + [(i, "b", 7) for i in range(5000)], weights=[1, 1])
    assert {s: sum(r.copies * r.size for r in got if r.source == s) for s in "ab"} == {"a": 42_500 // 10 * 10, "b": 42_497}
    clashing = spark.createDataFrame([(1, "a", 10, 5)], "doc_id long, source string, size long, rows long").withColumns({c: F.lit(0) for c in ("id", "from", "hash", "range", "times", "n")})
    assert [tuple(r) for r in M.mix(clashing).collect()] == [(1, "a", 10, 10, 10.0, 1)]


def test_mixing_query(spark):
    got = M.op13_mixing(spark, SF_SMALL).collect()
    documents = {d.doc_id: d for d in table(spark, SF_SMALL, "documents").collect()}
    assert sorted(r.doc_id for r in got) == sorted(documents)
    by = defaultdict(list)
    for r in got:
        assert r.size == len(WORDS.findall(documents[r.doc_id].text or ""))
        by[documents[r.doc_id].source].append(r)
    want = targets_brute({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert all(r.target == pytest.approx(want[s], rel=1e-12) for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= 1 + max(r.size for r in rs) / 2
