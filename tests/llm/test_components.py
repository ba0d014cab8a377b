"""Components of link tables against a plain union."""

import numpy as np
import pytest
from netvigil.llm import components


def _plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _found(spark, links, parts=5):
    rows = components.smallest_reachable(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


random = np.random.default_rng(5)
CASES = {
    "none": [],
    "odd": [(3, 3), (None, 4), (7, -2), (-2, 7), (7, 7), (7, 9), (9, 7)],
    "path": [(k, k + 1) for k in range(400)],
    "shuffled path": [(int(a), int(b)) for a, b in zip(*(lambda p: (p[:-1], p[1:]))(random.permutation(500)), strict=True)],
    "largest is the hub": [(10_000, k) for k in range(300)],
    "sparse": [(int(a), int(b)) for a, b in random.integers(-400, 400, (420, 2))],
    "far ends": [(-(1 << 63), (1 << 63) - 1), ((1 << 63) - 1, 0)],
}


@pytest.mark.parametrize("held", [60, 1_000_000])
@pytest.mark.parametrize("case", CASES)
def test_components(spark, monkeypatch, case, held):
    monkeypatch.setattr(components, "HELD", held)
    assert _found(spark, CASES[case]) == _plain(CASES[case])


def test_small_tables_make_few_exchanges(spark, monkeypatch):
    """Each exchange makes as many tasks as there are shuffle partitions, which filled an executor's heap."""
    plans = []

    def stored(df, name, plain=components.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(components, "stored", stored)
    links = [(k, k // 7) for k in range(1, 300)]
    assert _found(spark, links) == _plain(links)
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 6
