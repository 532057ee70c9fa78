"""Groups larger than a tile, frequent passages, and keys of very many nodes, against a plain join."""

import numpy as np
import pytest

from tessera.llm import jaccard
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def _corpus(seed=3, n=260):
    """Near copies of one text, some just too far from it, unlike texts around one passage, and chains."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(1 << 30)}"
    base, passage = [word() for _ in range(80)], [word() for _ in range(25)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind < 2:
            t = list(base)
            for at in rng.choice(80, int(rng.integers(0, 4)), replace=False):
                t[at] = word()
        elif kind == 2:
            t = [word() for _ in range(40)] + passage
        else:
            t = [f"c{j}" for j in range(i // 4, i // 4 + 70)]
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("block, held, many", [(512, 1 << 20, 1 << 16), (16, 1 << 20, 1 << 16), (8, 64, 8)])
def test_groups_of_any_size(spark, monkeypatch, block, held, many):
    rows = _corpus()
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "_HELD", held)
    monkeypatch.setattr(jaccard, "_MANY", many)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, 85).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard(rows, 4, 85))


def test_keys_of_many_nodes_pass_in_pieces(monkeypatch):
    monkeypatch.setattr(jaccard, "_HELD", 50)
    monkeypatch.setattr(jaccard, "_MANY", 20)
    rng = np.random.default_rng(1)
    rows = [(7, i) for i in range(100)] + [(k, n) for k in range(20, 40) for n in range(k % 4)] + [(7, 3)] * 5
    rng.shuffle(rows)
    bucket, got = jaccard._Bucket(), []
    for a in range(0, len(rows), 9):
        part = rows[a : a + 9]
        cols = np.asarray([r[0] for r in part], "<u8"), np.asarray([r[1] for r in part], "<i8"), np.full(len(part), 2, "<u2")
        for b in bucket.add(*cols):
            got += b.to_pylist()
    for b in bucket.close():
        got += b.to_pylist()
    want = {(k, n): min(20, len({x for j, x in rows if j == k})) for k, n in rows}
    assert {(r["key"], r["short"]): r["seen"] for r in got} == {x: c for x, c in want.items() if c > 1}


def test_bound_on_equal_segments():
    """Linked sets share as many kept segments as either needs."""
    rng, bands = np.random.default_rng(2), jaccard.Bands(85)
    for n in (3, 7, 13, 40, 200, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, int(n * 0.08)) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 64, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            band = max(bands.of(len(a)), bands.of(len(b)))
            (x, need_x), (y, need_y) = (jaccard.segment_keys(s, band, bands) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= max(need_x, need_y)
            assert min(need_x, need_y) >= 1


def test_very_long_text(spark):
    long = [f"t{i}" for i in range(400_000)]  # 2.7 MB
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-5], "x"])), (3, " ".join(long[200_000:])), (4, "a b c d e")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
