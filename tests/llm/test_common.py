import random

import pytest

from tracewright.llm import common as C


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(4)
    n = 3000
    if kind == "path":
        order = rng.sample(range(n), n)
        edges = list(zip(order, order[1:]))
    elif kind == "star":
        edges = [(7, i) for i in range(n)]
    elif kind == "random":
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
    else:
        edges = []
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r.id: r.component_id for r in C.components(df).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_slices():
    import numpy as np

    offs = np.array([0, 10, 10, 500, 501])
    assert [(i, j) for i, j in C.slices(offs, 100)] == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("few", [0, 50])
def test_components_by_rounds(spark, monkeypatch, few):
    """Rounds, and what one task finishes after them, give the least ids as well."""
    monkeypatch.setattr(C, "FEW", few)
    order = random.Random(5).sample(range(400), 400)
    df = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:]) if a % 40 and b % 40], "a long, b long").repartition(6)
    want, run = {}, []
    for x in [*order, 0]:
        if x % 40:
            run.append(x)
        else:
            want |= {y: min(run) for y in run if len(run) > 1}
            run = []
    assert {r.id: r.component_id for r in C.components(df).collect()} == want


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """A long path of few edges is written twice, not in every round."""
    names, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: names.append(name) or write(df, name))
    got = C.components(spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long").repartition(6)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 2001 and len(names) == 2
