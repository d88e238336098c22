"""Descendants by Euler tour against brute force: random forests, cycles, unknown parents, long chains, a hot parent."""

import random

import pytest

from codelens.operators import snapshots as S

SCHEMA = "snapshot_id long, parent_id long"


def brute(edges):
    """(ancestor, descendant, levels below, pre-order) of all pairs, nodes on or below a cycle left out."""
    parent = {n: p if p in dict(edges) else None for n, p in edges}
    kids = {}
    for n, p in sorted(parent.items()):
        kids.setdefault(p, []).append(n)
    out = []

    def below(n):
        todo = [(k, 1) for k in reversed(kids.get(n, []))]
        while todo:
            x, depth = todo.pop()
            yield x, depth
            todo += [(k, depth + 1) for k in reversed(kids.get(x, []))]

    roots = kids.get(None, [])
    for n in [*roots, *[x for r in roots for x, _ in below(r)]]:
        out += [(n, d, depth, k) for k, (d, depth) in enumerate(below(n), 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(1, 500), 60)
    edges = [(n, rng.choice([None, 9999, *nodes[max(0, i - 12): i]])) for i, n in enumerate(nodes)]
    edges += [(601, 602), (602, 601), (603, 602), (604, 604), (605, 604)]  # cycles, and nodes below them
    tour = S.euler_tour(spark.createDataFrame(edges, SCHEMA))
    want = brute(edges)
    assert sorted(map(tuple, S.descendants(tour).collect())) == want
    chosen = rng.sample(nodes, 5)
    some = S.descendants(tour, spark.createDataFrame([(c,) for c in [*chosen, 601, 7777]], "snapshot_id long"))
    assert sorted(map(tuple, some.collect())) == [w for w in want if w[0] in chosen]
    facts = {r.snapshot_id: r for r in tour.collect()}
    lineage = {r.snapshot_id: r for r in S.lineage(spark.createDataFrame(edges, SCHEMA), with_path=False).collect()}
    assert {n: (r.depth, r.root_id, r.cyclic) for n, r in facts.items()} == {n: (r.depth, r.root_id, r.cyclic) for n, r in lineage.items()}


def test_long_chain_and_hot_parent(spark):
    n = 100_000
    chain = spark.range(1, n + 1).selectExpr("id AS snapshot_id", "CASE WHEN id > 1 THEN id - 1 END AS parent_id")
    star = spark.range(n + 1, n + 3001).selectExpr("id AS snapshot_id", f"CASE WHEN id > {n + 1} THEN {n + 1} END AS parent_id")
    tour = S.euler_tour(chain.union(star))
    chosen = spark.createDataFrame([(1,), (n - 2,), (n + 1,)], "snapshot_id long")
    got = S.descendants(tour, chosen)
    rows = {(r.ancestor_id, r.descendant_id): (r.levels_below, r.preorder) for r in got.collect()}
    assert len(rows) == n - 1 + 2 + 2999
    assert rows[1, n] == (n - 1, n - 1) and rows[n - 2, n] == (2, 2) and rows[n + 1, n + 3000] == (1, 2999)


def test_no_nodes(spark):
    assert S.descendants(S.euler_tour(spark.createDataFrame([], SCHEMA))).collect() == []


def test_bushy_trees_are_ranked_by_their_core(spark, monkeypatch):
    """Of a tree of three children a node only the core is doubled: far fewer rows than two elements for each node."""
    doubled = []
    whole = S._doubled_until_done
    monkeypatch.setattr(S, "_doubled_until_done", lambda start, step, total: doubled.append(start.count()) or whole(start, step, total))
    n = 1093  # 1 + 3 + ... + 729
    edges = [(i, (i + 1) // 3 if i > 1 else None) for i in range(1, n + 1)]
    tour = S.euler_tour(spark.createDataFrame(edges, SCHEMA))
    assert doubled == [40, 40] or max(doubled) <= n // 20
    assert sorted(map(tuple, S.descendants(tour).collect())) == brute(edges)
