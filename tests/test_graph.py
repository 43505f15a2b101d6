"""Components against a plain search, in one task and by rounds of jobs."""

import random

import pytest

from groundswell.operators import graph


def plain(edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return {n: c for n, c in label.items() if n != c}


@pytest.mark.parametrize(("few", "many"), [(100_000, 1_000_000), (0, 1_000_000), (0, 0)])
def test_components(spark, monkeypatch, few, many):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "MANY", many)
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x["node"]: x["component"] for x in graph.components(df).collect()}
    assert got == plain([e for e in edges if e[0] != e[1]])
    assert graph.components(df.limit(0)).count() == 0
