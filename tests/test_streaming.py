"""Streams with state over several batches, in and out of order, against plain Python."""

import random
import uuid
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tracewright import streaming
from tracewright.operators.shared import shared_path

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def some_events(n, users, days):
    r = random.Random(9)
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(minutes=r.randrange(days * 1440)), r.randrange(users), round(r.uniform(0, 9), 3)) for i in range(n)]


@pytest.fixture
def run(spark):
    def go(batches, build, keyed=True):
        """Each batch is a file of its own, read in this order, one in each micro-batch."""
        path = shared_path(spark, "events")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
        root = f"{path}-{uuid.uuid4().hex}"
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
        frame, before = build(stream), spark.conf.get(streaming.STORE)
        if keyed:
            spark.conf.set(streaming.STORE, streaming.KEYED_STORE)
        try:
            frame.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(streaming.STORE, before)
        return spark.read.schema(frame.schema).parquet(f"{root}/out").collect()

    return go


@pytest.mark.parametrize("ordered", [True, False])
def test_cache_evicts_all_but_the_latest(run, ordered):
    rows = some_events(120, 3, 5)
    rows = sorted(rows, key=lambda x: x[1]) if ordered else rows
    got = sorted((r.user_id, r.event_id) for r in run([rows[:50], rows[50:51], rows[51:]], lambda s: streaming.bounded_cache(s, 8)))
    by_user = defaultdict(list)
    for i, ts, u, _ in rows:
        by_user[u].append((ts, i))
    assert got == sorted((u, i) for u, held in by_user.items() for _, i in sorted(held)[:-8])


@pytest.mark.parametrize("ahead", [0, 2])
def test_frames_are_folded_in_order(run, ahead):
    rows = sorted(some_events(90, 2, 12), key=lambda x: x[1])
    got = run([rows[:30], rows[30:31], rows[31:80], rows[80:]], lambda s: streaming.folded_frames(s, ahead))
    day = lambda ts: (ts - datetime(1970, 1, 1)).days
    mark = max(ts for _, ts, _, _ in rows) - timedelta(days=1)
    frames = defaultdict(list)
    for _, ts, u, v in rows:
        frames[u, day(ts)].append(v)
    want = {}
    for u in {u for u, _ in frames}:
        position, flow = None, 0.0
        for d in sorted(d for w, d in frames if w == u):
            mean = sum(frames[u, d]) / len(frames[u, d])
            step = 0.0 if position is None else mean - position
            if datetime(1970, 1, 1) + timedelta(days=d + 1 + ahead) <= mark:
                want[u, d] = (len(frames[u, d]), mean, step - flow, *(sum(frames[u, d + k]) / len(frames[u, d + k]) if (u, d + k) in frames and ahead else None for k in (1, 2)))
            position, flow = mean, (2 * flow + step) / 3
    assert {(r.user_id, r.day) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, mean, residual, *after = want[r.user_id, r.day]
        assert r.n == n and r.position == pytest.approx(mean) and r.residual == pytest.approx(residual)
        if ahead:
            assert [r.next1, r.next2] == [None if x is None else pytest.approx(x) for x in after]


def test_records_over_several_batches(run):
    rows = some_events(200, 3, 5)
    got = {(r.user_id, r.event_id) for r in run([rows[:70], rows[70:]], streaming.change_events, keyed=False)}
    best, want = defaultdict(lambda: float("-inf")), set()
    for i, _, u, v in rows:
        if v > best[u]:
            best[u] = v
            want.add((u, i))
    assert got == want
