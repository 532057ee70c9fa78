"""Digests and differences of trees against plain versions."""

import random

from tessera.operators import trees

SCHEMA = "doc_id long, node_id long, parent_id long, ordinal long, kind string, start long, len long, payload string"


def _tree(rng, doc, n):
    rows = [(doc, 0, None, 0, "root", 0, n, None)]
    for i in range(1, n):
        rows.append((doc, i, rng.randrange(max(0, i // 3 - 2), i // 2 + 1) if i > 2 else 0, i, rng.choice("ab"), i, 1, rng.choice([None, "x", "y"])))
    return rows


def _edited(rng, rows):
    out = [list(r) for r in rows]
    for r in out[1:]:
        if rng.random() < 0.1:
            r[7] = "z"
    gone = {r[1] for r in out[1:] if rng.random() < 0.05}
    for r in out:
        if r[2] in gone:
            gone.add(r[1])
    return [tuple(r) for r in out if r[1] not in gone]


def _values(rows, spans):
    """{(doc, node): (what stands for the digest, height, size, children)}"""
    kids = {}
    for r in rows:
        kids.setdefault((r[0], r[2]), []).append(r)
    out = {}
    for r in reversed(rows):
        own = [out[c[0], c[1]] for c in sorted(kids.get((r[0], r[1]), []), key=lambda c: (c[3], c[1]))]
        shown = (r[4], *((r[5], r[6]) if spans else ()), r[7], tuple(o[0] for o in own))
        out[r[0], r[1]] = (shown, max((o[1] for o in own), default=-1) + 1, 1 + sum(o[2] for o in own))
    return out


def _matched(old, new, spans):
    a, b = _values(old, spans), _values(new, spans)
    up = [{(r[0], r[1]): (r[0], r[2]) for r in rows} for rows in (old, new)]
    taken, was = [set(), set()], {}
    for h in range(max(v[1] for v in [*a.values(), *b.values()]), -1, -1):
        level = [sorted(k for k, v in d.items() if v[1] == h) for d in (a, b)]
        for side in (0, 1):
            taken[side] |= {k for k in level[side] if up[side][k] in taken[side]}
        free = [k for k in level[0] if k not in taken[0]]
        for k in level[1]:
            if k not in taken[1]:
                hit = next((o for o in free if o[0] == k[0] and a[o][0] == b[k][0]), None)
                if hit:
                    free.remove(hit)
                    was[k] = hit[1]
                    taken[0].add(hit)
                    taken[1].add(k)
    return {(k, was.get(k), k in taken[1]) for k in b}


def test_digests_and_diffs(spark):
    rng = random.Random(3)
    docs = 6
    old = [r for doc in range(docs) for r in _tree(rng, doc, rng.randrange(1, 30))]
    new = [r for doc in range(docs) for r in _edited(rng, [x for x in old if x[0] == doc])]
    for spans in (True, False):
        a, b = (trees.digests(spark.createDataFrame(rows, SCHEMA), spans) for rows in (old, new))
        values, got = _values(old, spans), a.collect()
        assert {(r.doc_id, r.node_id): (r.height, r["size"]) for r in got} == {k: v[1:] for k, v in values.items()}
        pairs = {(r.digest, values[r.doc_id, r.node_id][0]) for r in got}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
        if spans:
            continue
        found = {((r.doc_id, r.node_id), r.was, r.reused) for r in trees.matched(a, b).collect()}
        assert found == _matched(old, new, spans)
    whole = {r.doc_id: (r.nodes, r.changed, r.reused_subtrees) for r in trees.diff(a, a).collect()}
    assert whole == {d: (sum(r[0] == d for r in old), 0, 1) for d in range(docs)}


def test_positional(spark):
    one = [(1, 0, None, 0, "m", 0, 50, None), (1, 1, 0, 0, "p", 0, 20, None), (1, 2, 1, 0, "i", 1, 3, "A"), (1, 3, 0, 1, "p", 21, 29, None), (1, 4, 3, 0, "i", 22, 3, "B")]
    two = [(*r[:7], "C") if r[1] == 4 else r for r in one]
    a, b = (trees.digests(spark.createDataFrame(rows, SCHEMA)) for rows in (one, two))
    assert [tuple(r) for r in trees.positional_diff(a, b).collect()] == [(1, 5, 3, 2, 1)]
    assert [tuple(r) for r in trees.positional_diff(a, a).collect()] == [(1, 5, 0, 5, 1)]
    short = trees.digests(spark.createDataFrame(one[:3], SCHEMA))
    assert trees.positional_diff(a, short).collect() == []
    none = trees.digests(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and trees.matched(none, none).collect() == [] and trees.matched(none, a).where("reused").collect() == []


def test_payloads_are_not_stored(spark, monkeypatch):
    seen, put = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df, name: seen.append((name, df.columns)) or put(df, name))
    a = trees.digests(spark.createDataFrame([(1, 0, None, 0, "m", 0, 5, None), (1, 1, 0, 0, "p", 0, 5, "x" * 1000)], SCHEMA))
    assert all(len(r.digest) <= 24 for r in a.collect())
    assert not any("payload" in columns for _, columns in seen)
    assert [r.reused for r in trees.matched(a, a).collect()] == [True, True] and not {"old", "new"} & {n for n, _ in seen}
