"""Optimal assignment: the auction of large components against the exact solver."""

import random

import numpy as np
import pandas as pd
import pytest

from tracewright.operators import assign

SCHEMA = "dataset string, a long, b long, d double, cell long"


def some_pairs(seed, n, m, share):
    r = random.Random(seed)
    return [("m", a, b, r.uniform(0, 3), a // 4) for a in range(n) for b in range(m) if abs(a - b * n / m) < share * n and r.random() < 0.8]


def best(pairs):
    rows, cols = sorted({p[1] for p in pairs}), sorted({p[2] for p in pairs})
    table = np.full((len(rows), max(len(rows), len(cols))), 1e6)
    for _, a, b, d, _ in pairs:
        table[rows.index(a), cols.index(b)] = d
    got = [table[i, j] for i, j in enumerate(assign.solve_assignment(table))]
    return sum(x < 1e6 for x in got), sum(x for x in got if x < 1e6)


@pytest.mark.parametrize("n, m, block_pairs", [(8, 12, 75), (12, 8, 10_000)])
def test_auction_is_within_eps(spark, n, m, block_pairs):
    """In several blocks that outbid each other, and in one."""
    pairs = some_pairs(n, n, m, 0.25)
    got = assign.optimal_one_to_one(spark.createDataFrame(pairs, SCHEMA), place="cell", eps=0.01, small=0, block_pairs=block_pairs).collect()
    count, total = best(pairs)
    assert len(got) == count == len({r.a for r in got}) == len({r.b for r in got})
    assert total - 1e-9 <= sum(r.cost for r in got) <= total + 0.01 * 2 * (n + m)


def test_one_block_settles_alone():
    """Rows of one block bid until each holds a column, at prices within eps of their best choice."""
    pairs, big, eps = some_pairs(3, 30, 24, 0.2), 1e6, 1e-4
    edges = [(2 * a, 2 * b, d) for _, a, b, d, _ in pairs] + [(2 * b + 1, 2 * a + 1, 0.0) for _, a, b, _, _ in pairs]
    edges += [(2 * a, 2 * a + 1, big) for a in {p[1] for p in pairs}] + [(2 * b + 1, 2 * b, 0.0) for b in {p[2] for p in pairs}]
    held = pd.DataFrame(edges, columns=["row", "col", "cost"]).assign(dataset="m", price=0.0, owner=-1)
    for step in (1e5, 1e3, 10, 0.1, 1e-3, eps):
        held["owner"] = -1
        out = assign.local_auction(held, step)
        assert sorted(out["owner"]) == sorted(set(held["row"]))
        held["price"] = held["col"].map(out.set_index("col")["price"]).fillna(held["price"])
    cost = {(r, c): d for r, c, d in edges}
    taken = [cost[r, c] for r, c in zip(out["owner"], out["col"]) if r % 2 == 0 and c % 2 == 0]
    count, total = best(pairs)
    assert len(taken) == count and total - 1e-9 <= sum(taken) <= total + 2 * 54 * eps


def test_odd_pairs(spark):
    rows = [("m", 1, 10, 2.0, None), ("m", 1, 10, 1.0, 3), ("m", None, 10, 0.1, 1), ("m", 2, None, 0.1, 1), ("m", 2, 11, None, 1), ("m", 3, 12, 2e6, 1), ("k", 1, 10, 0.5, 1)]
    for small in (0, assign.SMALL):
        got = assign.optimal_one_to_one(spark.createDataFrame(rows, SCHEMA), place="cell", small=small, eps=1.0)
        assert {(r.dataset, r.a, r.b, r.cost) for r in got.collect()} == {("m", 1, 10, 1.0), ("k", 1, 10, 0.5)}
    assert assign.optimal_one_to_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_greedy_of_a_rising_chain(spark):
    """Costs that rise along a chain settle one pair a round, and all are settled."""
    rows = [("m", i, i, 2.0 * i) for i in range(6)] + [("m", i + 1, i, 2.0 * i + 1) for i in range(6)]
    got = assign.greedy_one_to_one(spark.createDataFrame(rows, "dataset string, a long, b long, d double")).collect()
    assert {(r.a, r.b) for r in got} == {(i, i) for i in range(6)}
