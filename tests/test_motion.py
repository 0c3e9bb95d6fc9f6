"""The motion fold against a loop over frames whose assignments try every choice."""

import math
import random
import statistics

from tracewright.operators import motion

NODE = "dataset string, node_id long, t int, z double, y double, x double"
SCALE = (1.625, 0.40625, 0.40625)


def _um(a, b):
    return math.sqrt(sum(((p - q) * s) ** 2 for p, q, s in zip(a, b, SCALE, strict=True)))


def _best(rows, options, taken=frozenset()):
    """(-pairs, cost, links): most pairs first, then the least cost."""
    if not rows:
        return 0, 0.0, ()
    best = _best(rows[1:], options, taken)
    for b, cost in options.get(rows[0], {}).items():
        if b not in taken:
            n, total, links = _best(rows[1:], options, taken | {b})
            best = min(best, (n - 1, total + cost, ((rows[0], b), *links)), key=lambda x: x[:2])
    return best


def _loop(at, frames, raw, gate):
    """(a, b) to stage of one movie."""
    got, flow, before = {}, [], {}

    def field(links):
        return [(at[a], [q - p for p, q in zip(at[a], at[b], strict=True)]) for a, b in links]

    def solve(now, after, samples, exclude, reach):
        options = {}
        for a in now:
            step = None
            if len(samples) >= gate.samples:
                near = sorted((_um(at[a], s[0]), i) for i, s in enumerate(samples) if _um(at[a], s[0]) <= gate.radius)[: gate.neighbours + 1]
                near = [i for d, i in near if d >= exclude][: gate.neighbours]
                step = [statistics.median(samples[i][1][c] for i in near) for c in range(3)] if near else None
            hit = step is not None
            if step is None:
                step = [gate.velocity * (p - q) for p, q in zip(at[a], before[a], strict=True)] if a in before else [0.0] * 3
            to = [p + s for p, s in zip(at[a], step, strict=True)]
            for b in after:
                d, m = _um(at[a], at[b]), _um(to, at[b])
                admits = gate.raw_admits or not hit or len(samples) < gate.samples
                if (admits and d <= reach) or (len(samples) >= gate.samples and m <= reach):
                    options.setdefault(a, {})[b] = m + gate.raw * d - gate.bonus * raw.get((a, b), 0.0)
        return list(_best(tuple(now), options)[2])

    for now, after in zip(frames, frames[1:], strict=False):
        if not now or not after:
            continue
        seeds = field(solve(now, after, flow, 0.0, gate.seed))
        first = solve(now, after, seeds, gate.exclude, gate.tight)
        left = [a for a in now if a not in {x for x, _ in first}], [b for b in after if b not in {x for _, x in first}]
        second = solve(*left, seeds, gate.exclude, gate.relaxed)
        got |= {k: "tight" for k in first} | {k: "relaxed" for k in second}
        flow = field(first + second)
        before |= {b: at[a] for a, b in first + second}
    return got


def test_the_fold_is_the_loop(spark):
    r = random.Random(21)
    rows, stages, raw, moved = [], set(), {}, 0
    gates = {"raw": motion.Motion(seed=2.5, tight=1.0, relaxed=4.0, radius=6.0, neighbours=3, bonus=1.0), "motion": motion.Motion(seed=2.5, tight=1.2, relaxed=4.0, radius=6.0, neighbours=3, bonus=1.0, raw_admits=False)}
    movies = {}
    for movie, drift in (("m", 4.0), ("n", 0.0)):
        at, frames = {}, []
        for t in range(4):
            frames.append([] if (movie, t) == ("n", 2) else [t * 10 + i for i in range(5)])
            for i, n in enumerate(frames[-1]):
                at[n] = (r.uniform(0, 1) + i % 2, 6 * i + drift * t + r.uniform(-2, 2), r.uniform(0, 6))
        rows += [(movie, n, n // 10, *p) for n, p in at.items()]
        own = {(a, b): round(r.random(), 2) for now, after in zip(frames, frames[1:], strict=False) for a in now for b in after if r.random() < 0.4}
        raw |= {(movie, *k): v for k, v in own.items()}
        movies[movie] = at, frames, own
    points = spark.createDataFrame([*rows, ("m", 99, 1, None, 0.0, 0.0)], NODE)
    likely = spark.createDataFrame([(*k, v) for k, v in raw.items()] + [("m", 0, 12, float("nan"))], "dataset string, source_id long, target_id long, edge_prob double")
    for gate in gates.values():
        want = {(movie, *k): stage for movie, (at, frames, own) in movies.items() for k, stage in _loop(at, frames, own, gate).items()}
        got = motion.motion_fold(points, likely, gate).collect()
        assert {(x.dataset, x.a, x.b): x.stage for x in got} == want and len(got) == len(want)
        moved += len(want)
        stages |= set(want.values())
    assert moved > 20 and stages == {"tight", "relaxed"}
    assert motion.motion_fold(points.limit(0), likely.limit(0)).count() == 0
