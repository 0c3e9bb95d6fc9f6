"""Operators against brute force on small random graphs and points."""

import itertools
import random

import numpy as np
import pytest

from tracewright.functions import clean_probability
from tracewright.operators import assign, graph, spatial
from tracewright.schema import EDGES, NODES, SCALE, Params
from tracewright.sources import files


def some_points(seed, n=60):
    r = random.Random(seed)
    return [("m", i, i % 3, r.uniform(-4, 4), r.uniform(-20, 20), r.uniform(-20, 20)) for i in range(n)]


def far(a, b):
    return sum(((a[3 + i] - b[3 + i]) * SCALE[i]) ** 2 for i in range(3)) ** 0.5


@pytest.mark.parametrize("radius", [0.7, 3.0])
def test_radius_join(spark, radius):
    p = some_points(1)
    df = spark.createDataFrame(p, NODES)
    got = {(r.a_node_id, r.b_node_id) for r in spatial.radius_join(df, df, radius, 1).collect()}
    assert got == {(a[1], b[1]) for a in p for b in p if b[2] == a[2] + 1 and far(a, b) <= radius}


def test_radius_join_without_rows_or_coordinates(spark):
    empty = spark.createDataFrame([], NODES)
    one = spark.createDataFrame([("m", 1, 0, None, 1.0, 1.0), ("m", 2, 0, 0.0, 0.0, 0.0)], NODES)
    assert spatial.radius_join(empty, one, 1.0).count() == 0
    assert [(r.a_node_id, r.b_node_id) for r in spatial.radius_join(one, one, 1.0).collect()] == [(2, 2)]


def test_components_of_paths_and_stars(spark):
    edges = [("p", i, i + 1, None) for i in range(40)] + [("s", 100, k, None) for k in range(101, 140)] + [("s", 7, 7, None)]
    got = {(r.dataset, r.node_id): r.component for r in graph.components(spark.createDataFrame(edges, EDGES)).collect()}
    assert all(got["p", i] == 0 for i in range(41))
    assert all(got["s", i] == 100 for i in range(100, 140))
    assert got["s", 7] == 7
    assert graph.components(spark.createDataFrame([], EDGES)).count() == 0


def test_walk_lengths(spark):
    nodes = spark.createDataFrame([("m", i, 0, 0.0, 0.0, 0.0) for i in range(20)], NODES)
    step = spark.createDataFrame([("m", i, i + 1) for i in range(15)], "dataset string, node_id long, next_id long")
    got = {r.node_id: r.length for r in graph.walk_lengths(nodes, step, 10).collect()}
    assert got == {i: min(10, max(0, 15 - i)) for i in range(20)}


def test_greedy_is_the_sequential_loop(spark):
    r = random.Random(3)
    pairs = [("m", a, b, round(r.uniform(0, 1), 2)) for a in range(12) for b in range(12) if r.random() < 0.5]
    got = {(x.a, x.b) for x in assign.greedy_one_to_one(spark.createDataFrame(pairs, "dataset string, a long, b long, d double")).collect()}
    left, right, want = set(), set(), set()
    for _, a, b, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    assert got == want


def test_assignment_is_optimal():
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = r.integers(0, 20, (n, m)).astype(float)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        at = assign.solve_assignment(cost)
        assert len(set(at)) == n and sum(cost[i, j] for i, j in enumerate(at)) == best


def test_optimal_prefers_more_matches(spark):
    pairs = spark.createDataFrame([("m", 1, 10, 0.1), ("m", 1, 11, 5.0), ("m", 2, 10, 5.0)], "dataset string, a long, b long, d double")
    assert {(r.a, r.b) for r in assign.optimal_one_to_one(pairs).collect()} == {(1, 11), (2, 10)}


def test_clean_probability(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.4,), (2.0,), (-30.0,)], "p double")
    got = [r[0] for r in rows.select(clean_probability(rows["p"])).collect()]
    assert got[:4] == [0.0, 0.0, 0.0, 0.4] and got[4] == pytest.approx(0.880797, abs=1e-6) and got[5] == pytest.approx(2.06e-9, rel=1e-2)


def test_merge_shards_checks_cover(spark):
    a, b = spark.range(0, 3), spark.range(3, 5)
    assert files.merge_shards([a, b], spark.range(5), "id").count() == 5
    for shards, expected in (([a, a], spark.range(3)), ([a], spark.range(5)), ([a, b], spark.range(4))):
        with pytest.raises(ValueError):
            files.merge_shards(shards, expected, "id")


def test_params_override():
    p = Params().override({"match_um": "5.5", "gap_max": "2", "unknown": "1"})
    assert (p.match_um, p.gap_max, p.edge_max_um) == (5.5, 2, 14.0)
