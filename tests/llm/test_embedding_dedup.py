import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import embedding_dedup as E

VEC = "vec_id long, embedding array<double>, label int, x string"


def brute(rows, t=0.95):
    ids = [i for i, _ in rows]
    unit = {i: E.unit(np.array(v, float)) if v is not None and all(c is not None for c in v) else None for i, v in rows}
    link = {i: {j for j in ids if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t} for i in ids}
    comp = {}
    for i in sorted(ids):
        if i in comp:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += link[k]
    return {i: (len(link[i]), comp[i]) for i in ids}


def run(spark, rows):
    return {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame([(i, v, 1, "z") for i, v in rows], VEC)).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    for i in range(0, 60, 2):
        base = np.array(rows[i][1])
        rows.append((1000 + i, (base * 3).tolist()))
        rows.append((1001 + i, (base + 0.05 * rng.standard_normal(16)).tolist()))
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None, *[1.0] * 15]), (2004, [float("nan")] * 16), (2005, [float("inf"), *[1.0] * 15]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e200] * 16), (2009, [1e-300] * 16)]
    assert run(spark, rows) == brute(rows)


def test_large_group(spark):
    """A group larger than a block, with members inside and outside the cap."""
    rng = np.random.default_rng(9)
    center = rng.standard_normal(16)
    center /= np.linalg.norm(center)
    rows = [(i, (center + s * rng.standard_normal(16)).tolist()) for i, s in enumerate([0.01] * 500 + [0.05] * 200 + [0.09] * 100)]
    rows += [(5000 + i, rng.standard_normal(16).tolist()) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], VEC)).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], None, None), (1, [1.0, 0.0], None, None), (2, [1.0, 0.0], 3, "a")], VEC)
    assert sorted(tuple(r)[:3] for r in E.near_vectors(rows).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_full_lists_hide_no_links(spark, monkeypatch):
    """Two tight bunches whose lists are full of own members are one component if they link."""
    rng = np.random.default_rng(12)
    one = E.unit(rng.standard_normal(32))
    side = rng.standard_normal(32)
    side = E.unit(side - (side @ one) * one)
    two = 0.96 * one + np.sqrt(1 - 0.96**2) * side
    rows = [(i, (c + 0.004 * rng.standard_normal(32)).tolist()) for i, c in enumerate([one] * 30 + [two] * 30)]
    rows += [(100 + i, rng.standard_normal(32).tolist()) for i in range(100)]
    want = brute(rows)
    assert {want[i][1] for i in range(60)} == {0} and min(want[i][0] for i in range(60)) > 29
    # with an audit of about one vector, so that it doesn't find the links itself
    monkeypatch.setattr(E, "AUDIT", 1)
    assert run(spark, rows) == want


def test_null_ids_and_wide_vectors(spark):
    rng = np.random.default_rng(3)
    wide = rng.standard_normal(20_000)
    rows = [(None, [1.0, 0.0], 1, "z"), (None, None, 1, "z"), (1, [1.0, 0.0], 1, "z"), (2, wide.tolist(), 1, "z"), (3, (wide * 2 + 1e-3).tolist(), 1, "z")]
    got = sorted(tuple(r) for r in E.near_vectors(spark.createDataFrame(rows, VEC)).collect())
    assert got == [(1, 0, 1, True, 1.0), (2, 1, 2, True, 1.0), (3, 1, 2, False, 1.0)]


def test_too_little_recall_is_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)], 1, "z") for i in range(9)], VEC)
    assert E.near_vectors(rows).count() == 9
    monkeypatch.setattr(E, "LEAST_RECALL", 1.5)
    with pytest.raises(RuntimeError, match="audited links"):
        E.near_vectors(rows)


def test_hubs_take_part_in_few_neighbourhoods(spark):
    graph = spark.createDataFrame([(u, 0, 0.5) for u in range(1, 5000)], "u long, v long, s float").withColumn("h", F.xxhash64("u", "v"))
    got = E._sampled(graph, "v", "u", 64)
    assert 50 <= got.count() <= 64 and got.select("v").distinct().count() == 1


def test_handed_on_edges_are_the_nearest(spark):
    """Each member keeps its best within a neighbourhood, and only those nearer than the last of its list."""
    rng = np.random.default_rng(1)
    x = np.array([E.unit(v) for v in rng.standard_normal((20, 8))])
    rows = [(0, [(i, x[i].astype(np.float32).tobytes(), -2.0 if i % 2 else 0.3) for i in range(20)])]
    group = spark.createDataFrame(rows, "c long, g array<struct<m:long,x:binary,low:float>>").select("g")
    got = {(r.u, r.v) for r in group.mapInArrow(lambda it: E._local_join(it, 4), E.EDGES).collect()}
    s = x @ x.T - 3 * np.eye(20)
    want = {(i, int(j)) for i in range(20) for j in np.argsort(-s[i])[:4] if s[i, j] > (-2.0 if i % 2 else 0.3)}
    assert got == want
