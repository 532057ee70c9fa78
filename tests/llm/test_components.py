"""Connected components against a plain union-find."""

import numpy as np
import pytest

from tessera.llm import components as module
from tessera.llm.components import components


def _plain(edges: list[tuple[int, int]]) -> dict[int, int]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("small", [0, 1 << 20])
@pytest.mark.parametrize("kind", ["none", "sparse", "path", "star"])
def test_components(spark, monkeypatch, kind, small):
    monkeypatch.setattr(module, "SMALL", small)
    rng = np.random.default_rng(1)
    edges = {
        "none": [],
        "sparse": [tuple(x) for x in rng.integers(-500, 500, (400, 2)).tolist()],
        "path": [(i, i + 1) for i in rng.permutation(300).tolist()],
        "star": [(999, i) for i in range(200)] * 2,  # the greatest node is the centre, links repeat
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    want = _plain(edges)
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
