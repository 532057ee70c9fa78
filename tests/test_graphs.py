"""Cycles and reachability of graphs against closures made by hand."""

import random

import pytest

from tessera.operators import cycles, project, reach
from tessera.operators.cycles import on_cycles
from tessera.operators.reach import build, reachable


def _closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return reach


def _cycles(edges):
    reach = _closure(edges)
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}


def _got(spark, edges):
    rows = on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


SHAPES = {
    "pure rounds": [(i, (i + 1) % 7) for i in range(7)] + [(10, 11), (11, 10), (20, 20)],
    "round with tails": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (9, 8), (8, 0)],
    "two rounds in one node": [(5, 1), (1, 2), (2, 5), (5, 3), (3, 4), (4, 5)],
    "rounds joined by a path": [(1, 2), (2, 1), (2, 30), (30, 31), (31, 5), (5, 6), (6, 5)],
    "paths side by side": [(1, 2), (2, 3), (1, 4), (4, 3), (3, 9), (9, 1)],
    "tree": [(i, i // 2) for i in range(2, 40)],
    "nulls and copies": [(None, 1), (1, None), (1, 2), (1, 2), (2, 1), (2, 2)],
}


@pytest.mark.parametrize("few", [0, cycles.FEW_EDGES])
def test_cycles_of_shapes_and_random_graphs(spark, monkeypatch, few):
    """All at once, as parts of one graph; by rounds alone and with one task for what is left."""
    monkeypatch.setattr(cycles, "FEW_EDGES", few)
    edges = [tuple(x if x is None else x + 100_000 * k for x in e) for k, part in enumerate(SHAPES.values()) for e in part]
    rng = random.Random(1)
    for part in range(20):
        n = rng.randrange(3, 25)
        edges += [(100 * part + rng.randrange(n), 100 * part + rng.randrange(n)) for _ in range(int(n * rng.uniform(0.5, 2)))]
    assert _got(spark, edges) == _cycles([e for e in edges if None not in e])
    assert _got(spark, []) == {} and _got(spark, [(1, 1), (1, 2)]) == {1: 1}


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    monkeypatch.setattr(cycles, "FEW_EDGES", 0)
    n = 10_000
    chain = spark.range(n).selectExpr("concat('m', lpad(id, 6, '0')) module", "concat('m', lpad(id + 1, 6, '0')) imported")
    assert project.circles(chain).collect() == []
    closed = chain.union(spark.createDataFrame([(f"m{n:06d}", "m000000")], chain.schema))
    found = project.circles(closed)
    assert found.count() == n + 1 and {r.other for r in found.select("other").distinct().collect()} == {"m000000"}


def _reach(spark, edges, pairs):
    index = build(spark.createDataFrame(edges, "child long, parent long"))
    assert index.labels.count() + index.others.count() <= len({x for e in edges for x in e}) + len(edges)
    return {tuple(r) for r in reachable(spark.createDataFrame(pairs, "from_id long, to_id long"), index).collect()}


@pytest.mark.parametrize("case", ["forest", "several parents", "cycles"])
def test_reachable(spark, case):
    rng = random.Random(case)
    edges = {"forest": [(i, rng.randrange(i)) for i in range(1, 80) if i % 9], "several parents": [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(3) if rng.random() < 0.7], "cycles": [(rng.randrange(50), rng.randrange(50)) for _ in range(60)]}[case]
    ids = sorted({x for e in edges for x in e})
    pairs = [(a, b) for a in ids for b in ids] + [(None, 1), (1, None), (9999, 1), (1, 9999)] + [(ids[0], ids[0])] * 50
    reach = _closure(edges)
    assert _reach(spark, edges, pairs) == {(a, b) for a, b in pairs if b in reach.get(a, ())}


def test_reachable_far_and_wide(spark):
    deep = [(i, i + 1) for i in range(2000)]
    wide = [(10_000 + i, 2000) for i in range(3000)]
    pairs = [(0, 2000), (2000, 0), (500, 499), (500, 1999), (10_007, 2000), (10_007, 10_008), (2999, 3000)]
    assert _reach(spark, deep + wide, pairs) == {(0, 2000), (500, 1999), (10_007, 2000)}
    empty = build(spark.createDataFrame([], "child long, parent long"))
    assert reachable(spark.createDataFrame(pairs, "from_id long, to_id long"), empty).collect() == []


def _counting(monkeypatch, module):
    """How many tables a module stores from now on, as a list that grows."""
    calls, put = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: calls.append(name) or put(df, name))
    return calls


def test_a_comb_is_trimmed_at_once(spark, monkeypatch):
    """Each node of a long chain points at a round too, so no path is short and only one node in turn has no edge in."""
    monkeypatch.setattr(cycles, "FEW_EDGES", 8)
    stored = _counting(monkeypatch, cycles)
    edges = [(i, i + 1) for i in range(10, 70)] + [(i, 1) for i in range(10, 71)] + [(1, 2), (2, 1)]
    assert _got(spark, edges) == {1: 1, 2: 1}
    assert len(stored) < 40


def test_a_comb_is_asked_in_few_rounds(spark, monkeypatch):
    stored = _counting(monkeypatch, reach)
    edges = [(i, i + 1) for i in range(10, 50)] + [(i, 1) for i in range(10, 51)]
    pairs = [(10, 50), (10, 1), (50, 10), (30, 29), (30, 31), (1, 50), (12, 999)]
    assert _reach(spark, edges, pairs) == {(10, 50), (10, 1), (30, 31)}
    assert stored.count("tried") <= 4
