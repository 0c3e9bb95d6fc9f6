"""Re-admission against a loop, and the independent set against a loop over random conflicts."""

import random

from tracewright.operators import readmission


def test_independent_set_is_the_loop(spark):
    r = random.Random(4)
    items = [("m", i, r.randint(0, 9)) for i in range(60)]
    claims = [("m", i, "k", r.randint(0, 25)) for i in range(60) for _ in range(2)] + [("m", i, "hub", 1 if i % 3 == 0 else None) for i in range(60)]
    clashes = [("m", *sorted(r.sample(range(60), 2), reverse=r.random() < 0.5)) for _ in range(40)]
    used, taken = set(), []
    near = {frozenset((a, b)) for _, a, b in clashes}
    for _, i, _ in sorted(items, key=lambda x: (x[2], x[1])):
        keys = {c[2:] for c in claims if c[1] == i and c[3] is not None}
        if not keys & used and not any(frozenset((i, j)) in near for j in taken):
            used |= keys
            taken.append(i)
    frame = spark.createDataFrame(items, "dataset string, item long, n int").selectExpr("dataset", "item", "struct(n, item) as rank")
    got = readmission.independent_by_rank(frame, spark.createDataFrame(claims, "dataset string, item long, kind string, key long"), spark.createDataFrame(clashes, "dataset string, a long, b long"))
    assert {x.item for x in got.collect()} == set(taken)


def test_guard_on_a_hand_graph(spark):
    """A bridge comes first, its rival for the same end goes, and an added point keeps its distance."""
    step = 1 / 0.40625  # one micrometre along x
    points = [("m", 1, 0, 0.0), ("m", 2, 1, 1.0), ("m", 3, 3, 3.0), ("m", 4, 4, 4.0), ("m", 5, 0, 20.0), ("m", 6, 1, 21.0), ("m", 7, 0, 40.0), ("m", 8, 1, 41.0)]
    points += [("m", 9, 0, 60.0), ("m", 10, 1, 61.0), ("m", 11, 2, 63.9)]
    cands = [("m", 100, 2, 2.0, 0.99), ("m", 101, 2, 22.0, 0.99), ("m", 102, 2, 22.2, 0.98), ("m", 103, 2, 42.0, 0.5), ("m", 104, 2, 62.5, 0.99)]
    frame = spark.createDataFrame([(d, i, t, 0.0, 0.0, x * step) for d, i, t, x in points], "dataset string, node_id long, t int, z double, y double, x double")
    low = spark.createDataFrame([(d, i, t, 0.0, 0.0, x * step, s) for d, i, t, x, s in cands], "dataset string, node_id long, t int, z double, y double, x double, score double")
    links = spark.createDataFrame([("m", 1, 2), ("m", 3, 4), ("m", 5, 6), ("m", 7, 8), ("m", 9, 10)], "dataset string, source_id long, target_id long")
    guard = readmission.Guard(share=1.0)
    got = {(r.endpoint, r.candidate, r.other, r.place) for r in readmission.readmit(frame, links, low, guard).collect()}
    # 6: two candidates within the margin; 8: its candidate scores too little; 10: a node is too close to its candidate
    assert got == {(2, 100, 3, 1)}
    assert readmission.readmit(frame, links, low, guard._replace(share=0.01)).count() == 0
    assert {r.candidate for r in readmission.readmit(frame, links, low, guard._replace(margin=0.0, score=0.1)).collect()} == {100, 101, 103}
    assert readmission.readmit(frame.limit(0), links.limit(0), low, guard).count() == 0
