"""Closure, walks and strongly connected components against plain versions."""

from __future__ import annotations

import random

import pytest

from forgeline.operators import graph, lineage


def plain_reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[n] = seen
    return reach


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string").repartition(3)


def random_pairs(seed):
    """Sparse random edges, a long path with a way back, a ring with tails on both sides, a bridge, a loop."""
    r = random.Random(seed)
    n = r.choice([6, 12, 30])
    name = lambda i: f"n{i:03d}"
    pairs = [(name(r.randrange(n)), name(r.randrange(n))) for _ in range(int(n * r.choice([0.8, 1.2, 2])))]
    pairs += [(f"p{i}", f"p{i + 1}") for i in range(20)] + ([("p20", "p7")] if seed % 2 else [])
    pairs += [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("t1", "t2"), ("t2", "r3"), ("r5", "u1"), ("u1", "u2"), ("u2", name(0))]
    return pairs + pairs[:5] + [("loop", "loop")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_closure_and_walks(spark, seed):
    pairs = random_pairs(seed)
    reach = plain_reach(pairs)
    edges = edges_of(spark, [*pairs, (None, "n000"), ("n000", None)])
    got = {r.node: r.component for r in graph.components_on_cycles(edges).collect()}
    on = {n for n, s in reach.items() if n in s}
    assert set(got) == on
    assert all((got[x] == got[y]) == (y in reach[x] and x in reach[y]) for x in on for y in on)
    whole = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    assert {(r.a, r.b) for r in graph.closure(whole).collect()} == {(n, x) for n, s in reach.items() for x in s}
    assert {r.node for r in graph.reachable(whole, "p0").collect()} == reach["p0"]


def test_a_ring_of_five_thousand_with_tails(spark):
    n = 5000
    ring = spark.range(n).selectExpr("concat('n', id) AS a", f"concat('n', (id + 1) % {n}) AS b")
    tails = spark.range(0, n, 500).selectExpr("id", "explode(sequence(0, 2)) AS k")
    into = tails.selectExpr("concat('t', id, '_', k) AS a", "IF(k = 2, concat('n', id), concat('t', id, '_', k + 1)) AS b")
    out = tails.selectExpr("IF(k = 0, concat('n', id), concat('u', id, '_', k - 1)) AS a", "concat('u', id, '_', k) AS b")
    got = graph.components_on_cycles(ring.union(into).union(out)).collect()
    assert {r.node for r in got} == {f"n{i}" for i in range(n)} and len(got) == n and len({r.component for r in got}) == 1


def test_long_paths_have_no_limit(spark):
    path = spark.range(3000).selectExpr("concat('n', id) AS source_dataset", "concat('n', id + 1) AS target_dataset")
    assert lineage.ancestors(path.filter("id < 40"), "n40").count() == 40
    assert lineage.cycles(path.filter("id < 100")).isEmpty()
    short = path.filter("id < 40")
    assert lineage.closure(short).count() == 40 * 41 // 2


def test_no_edges(spark):
    none = edges_of(spark, [("a", "b")]).filter("false")
    assert graph.closure(none).count() == graph.reachable(none, "a").count() == graph.components_on_cycles(none).count() == 0


def test_rounds_keep_the_estimated_size_small(spark, monkeypatch):
    seen = []
    for name in ("cut", "written"):
        def told(df, *rest, step=getattr(graph, name)):
            out = step(df, *rest)
            seen.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
            return out

        monkeypatch.setattr(graph, name, told)
    ring = spark.range(40).selectExpr("concat('n', id) AS a", "concat('n', (id + 1) % 40) AS b")
    assert graph.components_on_cycles(ring).count() == 40 and max(seen) < 64


def test_rings_and_open_chains_of_many_lengths(spark):
    rings = [(f"r{n}_{i}", f"r{n}_{(i + 1) % n}") for n in (2, 3, 4, 7, 16, 33) for i in range(n)]
    # two hubs with chains of many lengths between them and one back, and a hub whose one chain comes back to it
    chains = [e for n in (1, 2, 5, 9, 17) for e in zip(["h", *[f"c{n}_{i}" for i in range(n)]], [*[f"c{n}_{i}" for i in range(n)], "k"], strict=True)]
    more = [("k", "h"), ("k", "out"), ("s", "d0"), ("d0", "d1"), ("d1", "s"), ("s", "h")]
    pairs = rings + chains + more
    reach = plain_reach(pairs)
    got = {r.node: r.component for r in graph.components_on_cycles(edges_of(spark, pairs)).collect()}
    on = {n for n, s in reach.items() if n in s}
    assert set(got) == on and all((got[x] == got[y]) == (y in reach[x] and x in reach[y]) for x in on for y in on)


def test_a_round_of_the_closure_writes_its_pairs_once(spark, monkeypatch):
    seen = []

    def told(df, *rest, step=graph.written):
        seen.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return step(df, *rest)

    monkeypatch.setattr(graph, "written", told)
    monkeypatch.setattr(graph, "cut", None)
    path = spark.range(40).selectExpr("concat('n', id) AS a", "concat('n', id + 1) AS b")
    # distances of 1, 2, 4, 8, 16, 32, and then none of 64
    assert graph.closure(path).count() == 40 * 41 // 2 and len(seen) == 7 and max(seen) < 64
