"""Connected components against union-find."""

import random

from shelfspark.llm.graphs import components


def test_components(spark):
    rng = random.Random(6)
    chain = list(range(1000, 1150))
    rng.shuffle(chain)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + list(zip(chain, chain[1:])) + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), 12).collect()}
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
