"""Nearest neighbours by leaves, the sparse assignment and the assignment of nearest points against brute force."""

import math
import random

import numpy as np
import pytest

from tracewright.operators import assign, graph, spatial
from tracewright.schema import SCALE

POINTS = "dataset string, node_id long, t int, z double, y double, x double"


def some_points(seed, n, spread=6.0, first=0):
    r = random.Random(seed)
    grid = lambda: round(r.uniform(-spread, spread) * 2) / 2
    return [(f"d{i % 2}", first + i, i % 4 // 2, grid() / 1.625, grid() / 0.40625, grid() / 0.40625) for i in range(n)]


def um(p, q):
    return math.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(p[3:], q[3:], SCALE, strict=True)))


def brute(left, right, k, radius, dt, other, inner):
    out = set()
    for p in left:
        d = sorted((um(p, q), q[1]) for q in right if q[0] == p[0] and q[2] == p[2] + dt and not (other and p[1] == q[1]))
        out |= {(p[1], b) for _, b in [x for x in d if inner <= x[0] <= radius][:k]}
    return out


@pytest.mark.parametrize("k, radius, dt, other, inner", [(1, 3.0, 1, True, 0.0), (4, 20.0, 0, True, 0.0), (3, 9.0, 0, False, 2.0)])
def test_nearest_over_many_leaves(spark, monkeypatch, k, radius, dt, other, inner):
    """Points on a coarse grid, so distances tie, in leaves of a few points; some rows lie twice, one has no coordinate."""
    rows = some_points(1, 160) + [("d0", 900 + i, 0, 1.0, 1.0, 1.0) for i in range(30)]
    odd = [("d0", 990, 0, None, 1.0, 1.0), ("d0", 991, 0, float("nan"), 1.0, 1.0)]
    frame = spark.createDataFrame(rows + odd, POINTS)
    cut = spatial.leaves(frame, size=8)
    assert cut.select("leaf").distinct().count() > 10
    got = spatial.nearest_of_leaves(cut, cut, k, radius, dt, other, inner).collect()
    assert {(r.a_node_id, r.b_node_id) for r in got} == brute(rows, rows, k, radius, dt, other, inner)


def test_sparse_assignment_is_best():
    for seed in range(60):
        r = np.random.default_rng(seed)
        n, m = r.integers(1, 16, 2)
        cost = np.round(r.random((n, m)) * 6) / 2 if seed % 2 else r.random((n, m)) - 0.3
        fit = r.random((n, m)) < (0.15, 0.4, 0.9)[seed % 3]
        a, b = np.nonzero(fit)
        if not len(a):
            continue
        dense = np.full((n, max(n, m)), 1e6)
        dense[a, b] = cost[a, b]
        want = [dense[i, j] for i, j in enumerate(assign.solve_assignment(dense)) if dense[i, j] < 1e6]
        taken, profit = assign.solve_sparse(a, b, cost[a, b])
        got = taken[taken >= 0]
        assert len(got) == len(want) == len(set(a[got])) == len(set(b[got]))
        assert math.isclose(cost[a, b][got].sum(), sum(want), abs_tol=1e-9)


def test_pairs_that_matter_are_fetched(spark, monkeypatch):
    """With two pairs of each row at first, rows that crowd get more of theirs until the whole optimum is found."""
    monkeypatch.setattr(assign, "NEAR", 2)
    monkeypatch.setattr(assign, "MORE", 2)
    r = random.Random(4)
    rows = [("m", i, 0, r.gauss(0, 0.4), r.gauss(0, 1), r.gauss(0, 1)) for i in range(24)]
    cols = [("m", 100 + i, 0, r.gauss(0, 0.4), r.gauss(0, 1), r.gauss(0, 1)) for i in range(26)]
    dense = np.array([[um(p, q) for q in cols] for p in rows])
    dense[dense > 1.2] = 1e6
    want = [x for x in (dense[i, j] for i, j in enumerate(assign.solve_assignment(dense))) if x < 1e6]
    near = assign.optimal_nearest(spark.createDataFrame(rows, POINTS), spark.createDataFrame(cols, POINTS), 1.2, 0)
    pairs = [("m", p[1], q[1], um(p, q)) for p in rows for q in cols if um(p, q) <= 1.2]
    listed = assign.optimal_one_to_one(spark.createDataFrame(pairs, "dataset string, a long, b long, d double"))
    for got in (near.collect(), listed.collect()):
        assert len(got) == len({x.a for x in got}) == len({x.b for x in got}) == len(want)
        assert math.isclose(sum(x.cost for x in got), sum(want), abs_tol=1e-6)


@pytest.mark.parametrize("few", [0, 5])
def test_last_edges_of_components(spark, few):
    """A path of 40, a ring and a pair, with all edges contracted in rounds and the last ones in one task."""
    edges = [("m", i, i + 1) for i in range(40)] + [("m", 50 + i, 50 + (i + 1) % 7) for i in range(7)] + [("k", 1, 2)]
    got = graph.components(spark.createDataFrame(edges, "dataset string, source_id long, target_id long"), few=few).collect()
    want = {("m", i): 0 for i in range(41)} | {("m", 50 + i): 50 for i in range(7)} | {("k", 1): 1, ("k", 2): 1}
    assert {(r.dataset, r.node_id): r.component for r in got} == want
