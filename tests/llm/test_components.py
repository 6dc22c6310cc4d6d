from __future__ import annotations

import random

import pytest

from rankloom.llm.components import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("case", ["random", "path", "star", "odd", "empty"])
def test_components(spark, case):
    rng = random.Random(1)
    links = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(i, i + 1) for i in rng.sample(range(400), 400)],
        "star": [(0, i) if i % 2 else (i, 1000) for i in range(1, 300)],
        "odd": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (-7, 3)],
        "empty": [],
    }[case]
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == brute(links)
