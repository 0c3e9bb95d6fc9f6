"""One-to-one assignment: greedy by score as a fixed point, optimal by small blocks and an auction."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .graph import components
from .shared import checkpointed


#: A component of at most so many pairs is solved in one task; smaller ones share tasks up to BLOCK_PAIRS.
SMALL = 1_000_000
#: Pairs that one task of the auction holds, about.
BLOCK_PAIRS = 50_000
#: Pairs of a row that are looked at first, and how many times more where prices leave others a chance.
NEAR, MORE = 16, 8
#: Profit above the cost of a pair left out that is put down to rounding.
SURE = 1e-9


def greedy_one_to_one(pairs: DataFrame, cost: str = "d") -> DataFrame:
    """The pairs (dataset, a, b) that a loop in order of (cost, a, b) would take, each side once.

    A pair that is best for both its ends is taken; what touches it goes. With a
    total order this ends in the same set as the sequential loop. The least pair of
    all is always taken, so every round makes progress.
    """
    live = checkpointed(pairs.select("dataset", "a", "b", cost), "pairs")
    taken = None
    key = F.struct(cost, "a", "b")
    while not live.isEmpty():
        best = live.withColumn("ba", F.min(key).over(Window.partitionBy("dataset", "a"))).withColumn("bb", F.min(key).over(Window.partitionBy("dataset", "b")))
        new = checkpointed(best.where((F.col("ba") == key) & (F.col("bb") == key)).select("dataset", "a", "b", cost), "taken")
        taken = new if taken is None else taken.union(new)
        live = live.join(new.select("dataset", "a"), ["dataset", "a"], "left_anti").join(new.select("dataset", "b"), ["dataset", "b"], "left_anti")
        live = checkpointed(live.select("dataset", "a", "b", cost), "pairs")
    return live if taken is None else taken


def solve_assignment(cost: np.ndarray) -> list[int]:
    """Column of each row (n rows, m >= n columns) at the least total cost, by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        low, used, j0 = np.full(m + 1, np.inf), np.zeros(m + 1, bool), 0
        while owner[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def solve_sparse(row: np.ndarray, col: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row 0, 1, ... the index of the pair it takes, or -1, and its profit: most pairs, then the least total cost.

    Prices of columns start at 0 and only rise; a row that is not matched takes a column of
    its own at a cost that no exchange outweighs. In the end every pair costs, with the price of its
    column, at least the profit of its row, and just that where it is taken. Rows bid for
    their cheapest column up to the next one; those that tie or keep losing are placed by shortest augmenting paths.
    """
    n, m = int(row.max()) + 1 if len(row) else 0, int(col.max()) + 1 if len(col) else 0
    order = np.argsort(row, kind="stable")
    col, cost, cut = col[order], cost[order], np.searchsorted(row[order], np.arange(n + 1))
    alone = min(n, m) * (cost.max() - cost.min()) + cost.max() + 1 if n else 0.0
    price, owner, taken, profit = np.zeros(m), np.full(m, -1), np.full(n, -1), np.full(n, float(alone))
    free, bids, late = deque(range(n)), np.zeros(n, int), []
    while free:
        i = free.popleft()
        part = slice(cut[i], cut[i + 1])
        paid = cost[part] + price[col[part]]
        best = int(np.argmin(paid)) if len(paid) else -1
        if best < 0 or paid[best] >= alone:
            profit[i] = alone
            continue
        least, j, bids[i] = paid[best], col[cut[i] + best], bids[i] + 1
        paid[best] = np.inf
        second = min(paid.min(), alone)
        if bids[i] > 20 or (owner[j] >= 0 and second <= least):
            late.append(i)
            continue
        price[j] += second - least
        if owner[j] >= 0:
            taken[owner[j]] = -1
            free.append(owner[j])
        owner[j], taken[i], profit[i] = i, cut[i] + best, second
    far, came = np.full(m, np.inf), np.full(m, -1)  # length of the path to a column, and its last pair
    pair_row = np.repeat(np.arange(n), np.diff(cut))
    for i in late:
        part = slice(cut[i], cut[i + 1])
        profit[i] = min((cost[part] + price[col[part]]).min(), alone)
        heap, seen, done = [], [], []
        end, last, r, base = alone - profit[i], -1, i, 0.0  # ``last``: the free column at the end, -1 if row ``out`` takes its own
        out = i
        while True:
            part = slice(cut[r], cut[r + 1])
            to = col[part]
            length = base + np.maximum(cost[part] + price[to] - profit[r], 0)  # rounding may leave less than 0
            at = np.flatnonzero(length < np.minimum(far[to], end))
            if len(at):
                to, length = to[at], length[at]
                far[to], came[to] = length, cut[r] + at
                seen.append(to)
                open_ = owner[to] < 0
                if open_.any():
                    x = int(np.argmin(np.where(open_, length, np.inf)))
                    end, last = length[x], to[x]
                for d, j in zip(length[~open_].tolist(), to[~open_].tolist(), strict=True):
                    heapq.heappush(heap, (d, j))
            while heap and heap[0][0] > far[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            base, j = heapq.heappop(heap)
            done.append(j)
            r = owner[j]
            if base + alone - profit[r] < end:
                end, last, out = base + alone - profit[r], -1, r
        profit[i] += end
        if done:
            j = np.array(done)
            rise = np.maximum(end - far[j], 0)
            price[j] += rise
            profit[owner[j]] += rise
        if last < 0 and out != i:
            last = col[taken[out]]
            taken[out] = -1
        while last >= 0:
            pair = came[last]
            r = pair_row[pair]
            before = -1 if r == i else col[taken[r]]
            owner[last], taken[r] = r, pair
            last = before
        for to in seen:
            far[to], came[to] = np.inf, -1
    return np.where(taken >= 0, order[taken], -1) if n else taken, profit


SOLVED = "dataset string, a long, b long, cost double, hit boolean, open boolean"


def solve_bin(frame: pd.DataFrame) -> pd.DataFrame:
    """SOLVED, a row for each ``a`` of some components' pairs: what it takes if anything, and whether a pair left out (of ``bound`` at least) might change that."""
    rows, at = np.unique(frame["a"].to_numpy(), return_inverse=True)
    bound = np.full(len(rows), np.inf)
    bound[at] = frame["bound"].fillna(np.inf).to_numpy()
    real = frame["cost"].notna().to_numpy()
    cols, to = np.unique(frame["b"].to_numpy()[real], return_inverse=True)
    cost, here = frame["cost"].to_numpy()[real], np.full(len(rows), -1)
    some, at = np.unique(at[real], return_inverse=True)
    profit = np.full(len(rows), np.inf)
    here[some], profit[some] = solve_sparse(at, to, cost)
    hit = here >= 0
    profit[~hit] = np.inf
    b, paid = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    b[hit], paid[hit] = cols[to[here[hit]]], cost[here[hit]]
    return pd.DataFrame({"dataset": np.full(len(rows), frame["dataset"].iloc[0], object), "a": rows, "b": b, "cost": paid, "hit": hit, "open": (bound < np.inf) & (profit > bound + SURE)})


def local_auction(frame: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Bids of one block's rows until each holds a column at the prices that the block sees.

    ``frame``: row, col, cost, price, owner, sorted or not. Returns col, price and owner of
    the columns whose owner changed.
    """
    cols, at = np.unique(frame["col"].to_numpy(), return_inverse=True)
    rows, of = np.unique(frame["row"].to_numpy(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    at, cost = at[order], frame["cost"].to_numpy()[order]
    cut = np.searchsorted(of[order], np.arange(len(rows) + 1))
    price, holder = np.zeros(len(cols)), np.full(len(cols), -1)
    price[at], owner = frame["price"].to_numpy()[order], frame["owner"].to_numpy()[order]
    seen = pd.Series(np.arange(len(rows)), index=rows)
    holder[at] = seen.reindex(owner).fillna(-1).to_numpy().astype(int)  # -1: none, or a row of another block
    holds = np.zeros(len(rows), bool)
    holds[holder[holder >= 0]] = True
    free, touched = deque(np.flatnonzero(~holds)), np.zeros(len(cols), bool)
    while free:
        i = free.popleft()
        mine = at[cut[i] : cut[i + 1]]
        paid = cost[cut[i] : cut[i + 1]] + price[mine]
        best = int(np.argmin(paid))
        j, least = mine[best], paid[best]
        paid[best] = np.inf
        price[j] += paid.min() - least + eps
        if holder[j] >= 0:
            free.append(holder[j])
        holder[j], touched[j] = i, True
    return pd.DataFrame({"dataset": frame["dataset"].iloc[0], "col": cols[touched], "price": price[touched], "owner": rows[holder[touched]]})


def _bidder(eps: float):
    return lambda frame: local_auction(frame, eps)


def auction(pairs: DataFrame, big: float, eps: float, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(dataset, a, profit, b, cost, hit) of ``pairs(dataset, a, b, cost, place)``, the last three null where a row stays alone: total cost within ``eps`` a row and column of the least.

    Every row gets a column of its own for ``big`` and every column a row of its
    own for nothing, so all are matched in the end and prices may be kept from one
    ``eps`` to the next, smaller one. The rows of a block (rows of one ``place``, cut by
    hash where it has more than ``block_pairs`` pairs) bid in one task at the prices
    that the last round left; a column goes to the highest bid of all blocks, whoever is
    outbid bids again. Bids were made at prices that only rise, so each winner stays
    within ``eps`` of its best choice. Each round raises some price, and only blocks
    with an outbid row take part; they are grouped anew in every round, all in one
    task once they fit, so that neighbours of different blocks settle among themselves.
    """
    # an exchange that gains a pair costs less than this, so more pairs always win
    most = pairs.agg(F.max("cost"), F.least(F.countDistinct("dataset", "a"), F.countDistinct("dataset", "b"))).first()
    big = min(big, most[0] * most[1] + 1)
    load = pairs.groupBy("dataset", "place").agg(F.count(F.lit(1)).alias("load"))
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("load") / block_pairs))
    pairs = pairs.join(load, ["dataset", "place"]).withColumn("block", F.xxhash64("dataset", "place", part)).drop("load", "place")
    pairs = checkpointed(pairs.withColumn("back", F.min("block").over(Window.partitionBy("dataset", "b"))), "blocks")
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    edge = lambda block, row, col, cost: pairs.select("dataset", block, row.alias("row"), col.alias("col"), cost.alias("cost"))
    block, back = F.col("block"), F.col("back").alias("block")
    edges = edge(block, 2 * a, 2 * b, F.col("cost")).union(edge(back, 2 * b + 1, 2 * a + 1, zero))
    edges = edges.union(edge(block, 2 * a, 2 * a + 1, F.lit(float(big))).distinct()).union(edge(back, 2 * b + 1, 2 * b, zero).distinct())
    edges = checkpointed(edges, "edges")
    rows = checkpointed(edges.select("dataset", "block", F.col("row").alias("owner")).distinct(), "rows")
    prices = edges.select("dataset", "col").distinct().withColumns({"price": zero, "owner": F.lit(-1).cast("long")})
    loads, turn = checkpointed(edges.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("load")), "loads"), 0
    steps = [big / 4]
    while steps[-1] > eps:
        steps.append(max(steps[-1] / 10, eps))
    for step in steps:
        prices = checkpointed(prices.withColumn("owner", F.lit(-1).cast("long")), "prices")
        while True:
            owned = prices.where("owner >= 0").select("dataset", "owner")
            active = checkpointed(rows.join(owned, ["dataset", "owner"], "left_anti").select("dataset", "block").distinct().join(loads, ["dataset", "block"]), "active")
            load, turn = active.agg(F.sum("load")).first()[0], turn + 1
            if load is None:
                break
            group = F.pmod(F.xxhash64("block", F.lit(turn)), F.lit(-(-load // block_pairs))).alias("block")
            seen = edges.join(active, ["dataset", "block"]).join(prices, ["dataset", "col"]).select("dataset", group, "row", "col", "cost", "price", "owner")
            bids = seen.groupBy("dataset", "block").applyInPandas(_bidder(step), "dataset string, col long, price double, owner long")
            best = prices.unionByName(bids).groupBy("dataset", "col").agg(F.max(F.struct("price", "owner")).alias("m"))
            prices = checkpointed(best.select("dataset", "col", "m.price", "m.owner"), "prices")
    taken = prices.where("owner % 2 = 0 and col % 2 = 0").select("dataset", F.expr("owner div 2").alias("a"), F.expr("col div 2").alias("b"))
    won = pairs.join(taken, ["dataset", "a", "b"]).select("dataset", "a", "b", "cost", F.lit(True).alias("hit"))
    profit = edges.where("row % 2 = 0").join(prices, ["dataset", "col"]).groupBy("dataset", F.expr("row div 2").alias("a")).agg(F.min(F.col("cost") + F.col("price")).alias("profit"))
    return profit.join(won, ["dataset", "a"], "left")


def _solved(pairs: DataFrame, big: float, eps: float, small: int, block_pairs: int) -> DataFrame:
    """SOLVED of ``pairs(dataset, a, b, cost, place, bound)``, component by component."""
    spread = pairs.limit(block_pairs + 1).count() > block_pairs
    if small and not spread:
        return checkpointed(pairs.groupBy("dataset").applyInPandas(solve_bin, SOLVED), "solved")
    sides = pairs.select("dataset", (F.col("a") * 2).alias("source_id"), (F.col("b") * 2 + 1).alias("target_id"))
    part = components(sides).where("node_id % 2 = 0").select("dataset", F.expr("node_id div 2").alias("a"), "component")
    pairs = checkpointed(pairs.join(part, ["dataset", "a"]), "components")
    load = checkpointed(pairs.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("load")), "loads")
    total, most = load.agg(F.sum("load"), F.max("load")).first()
    lot = F.when(F.col("load") * 8 > block_pairs, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(-(-total // block_pairs))))
    small_ones = load.where(F.col("load") <= small).select("dataset", "component", lot.alias("lot"))
    key, tasks = ("dataset", "lot"), max(2 * pairs.sparkSession.sparkContext.defaultParallelism, min(2_000, -(-total // block_pairs)))
    solved = checkpointed(pairs.join(small_ones, ["dataset", "component"]).repartition(tasks, *key).groupBy(*key).applyInPandas(solve_bin, SOLVED), "solved")
    if most <= small:
        return solved
    large = checkpointed(pairs.join(load.where(F.col("load") > small), ["dataset", "component"], "left_semi"), "large")
    done = auction(large.where("cost is not null").select("dataset", "a", "b", "cost", "place"), big, eps, block_pairs)
    done = large.groupBy("dataset", "a").agg(F.min("bound").alias("bound")).join(done, ["dataset", "a"], "left")
    profit = F.when(F.col("hit"), F.col("profit")).otherwise(float("inf"))
    done = done.select("dataset", "a", F.coalesce("b", F.lit(0).cast("long")).alias("b"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce(profit > F.col("bound") + eps, F.lit(False)).alias("open"))
    return checkpointed(solved.unionByName(done), "solved")


def _grown(fetch: Callable[[DataFrame | None, int], DataFrame], big: float, eps: float, small: int, block_pairs: int) -> DataFrame:
    """(dataset, a, b, cost): the best assignment of all pairs, of which ``fetch(rows, k)`` gives the ``k`` cheapest of each row.

    ``fetch`` adds ``bound``, the least cost that a pair left out of the row may have, null where
    none is left out, and a row without a fit pair has a null ``cost``. Prices are not negative, so a row whose profit
    is within its bound would gain by no pair left out. The other rows get more of theirs, all in the end.
    """
    k = NEAR
    pairs = checkpointed(fetch(None, k), "near")
    while True:
        solved = _solved(pairs, big, eps, small, block_pairs)
        wanting = checkpointed(solved.where("open").select("dataset", "a"), "open")
        if wanting.isEmpty():
            return solved.where("hit").select("dataset", "a", "b", "cost")
        k *= MORE
        pairs = checkpointed(pairs.join(wanting, ["dataset", "a"], "left_anti").unionByName(fetch(wanting, k)), "near")


def optimal_one_to_one(pairs: DataFrame, cost: str = "d", big: float = 1e6, place: str | None = None, eps: float = 1e-4, small: int = SMALL, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Most pairs first, then least total cost, of gated ``pairs(dataset, a, b, cost)``; ids are not negative.

    The cheapest pairs of each row are solved first, and others added until prices show that
    none left out can lower the total. Connected components of what is looked at are independent. Those of
    at most ``small`` pairs are solved exactly, each in one task; larger ones by an
    auction, whose total is within ``eps`` a point of the least. ``place`` may name a
    column by which rows that compete are likely to be together, such as a grid cell;
    it steers cost only. Of repeated pairs the cheapest counts; pairs without an end
    or a cost are left out, and a row that is ``big`` or dearer is no pair.
    """
    near = F.col(place) if place else F.lit(0)
    pairs = pairs.select("dataset", "a", "b", F.col(cost).cast("double").alias("cost"), near.alias("place")).where((F.col("cost") < big) & F.col("a").isNotNull() & F.col("b").isNotNull())
    pairs = pairs.groupBy("dataset", "a", "b").agg(F.min("cost").alias("cost"), F.min("place").alias("place"))
    row = Window.partitionBy("dataset", "a")
    pairs = pairs.withColumns({"rank": F.row_number().over(row.orderBy("cost", "b")), "n": F.count(F.lit(1)).over(row)})
    pairs = checkpointed(pairs, "gated")

    def fetch(rows: DataFrame | None, k: int) -> DataFrame:
        some = pairs.where(F.col("rank") <= k)
        some = some if rows is None else some.join(rows, ["dataset", "a"], "left_semi")
        bound = F.when(F.col("n") > k, F.max("cost").over(row))
        return some.select("dataset", "a", "b", "cost", "place", bound.alias("bound"))

    return _grown(fetch, big, eps, small, block_pairs)


def optimal_nearest(rows: DataFrame, cols: DataFrame, radius: float, dt: int, cost: Callable[[DataFrame], DataFrame] | None = None, share: float = 1.0, eps: float = 1e-4, small: int = SMALL, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``optimal_one_to_one`` of points and those of frame ``t + dt`` within ``radius``, without the pairs that cannot matter; the side with fewer points should be ``rows``.

    ``cost`` turns (dataset, a, b, d, bound) into the same with ``cost``, null where a pair is no
    pair, and ``share`` of ``d`` at least; without it the cost is ``d``. It may make ``bound`` null where the row has no pairs beyond.
    """
    right = spatial.leaves(cols)

    def fetch(some: DataFrame | None, k: int) -> DataFrame:
        left = rows if some is None else rows.join(some.withColumnRenamed("a", "node_id"), ["dataset", "node_id"], "left_semi")
        near = checkpointed(spatial.nearest_of_leaves(spatial.leaves(left), right, k, radius, dt, other=False), "nearest")
        row = Window.partitionBy("dataset", "a_node_id")
        near = near.withColumn("bound", F.when(F.count(F.lit(1)).over(row) >= k, share * F.max("d").over(row)))
        near = near.select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), "d", "bound")
        near = near.withColumn("cost", F.col("d")) if cost is None else cost(near)
        return near.select("dataset", "a", "b", "cost", F.lit(0).alias("place"), "bound")

    return _grown(fetch, float("inf"), eps, small, block_pairs)
