"""Connected components and streamed groups."""

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm.common import components
from docketry.llm.common_groups import roots, sorted_groups


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("edges", [
    [],
    [(1, 1)],
    [(i, i + 1) for i in range(40)],  # a path
    [(0, i) for i in range(1, 200)] + [(7, 7), (300, 301), (301, 302), (5, 6)],  # a hub, a loop, a second component
    [(9, 1), (9, 2), (9, 3), (8, 3), (8, 4), (20, 10), (10, 20)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == brute(edges)


def test_groups_survive_batch_borders():
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    rows = pa.record_batch({"k": keys, "x": list(range(10))})
    for size in (1, 2, 3, 10):
        got = []
        for batch, starts in sorted_groups((rows.slice(i, size) for i in range(0, 10, size)), 1):
            got += [batch.column(1).to_pylist()[a:b] for a, b in zip(starts[:-1], starts[1:])]
        assert [x for g in got for x in g] == list(range(10))
        assert [len(g) for g in got] == [1 * 2, 1, 4, 1, 2]


def test_roots():
    linked = np.zeros((5, 5), bool)
    for a, b in ((1, 3), (3, 4)):
        linked[a, b] = linked[b, a] = True
    assert roots(linked).tolist() == [0, 1, 2, 1, 1]
