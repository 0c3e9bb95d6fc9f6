"""The division rules of the scorer on graphs written by hand."""

from tracewright.plans.scoring import division_counts

EDGES = "dataset string, s long, t long"


def counts(spark, match, predicted, true):
    ids = sorted({n for e in predicted for n in e} | {a for a, _ in match})
    nodes = spark.createDataFrame([("d", n) for n in ids], "dataset string, node_id long")
    frames = [spark.createDataFrame([("d", *e) for e in rows], k) for rows, k in ((match, "dataset string, a long, b long"), (predicted, EDGES), (true, EDGES))]
    (row,) = division_counts(nodes, *frames).collect()
    return row["div_tp"], row["div_fp"], row["div_fn"]


#: Node 1 continues from 0 and divides into 2 and 3, which go on to 4 and 5.
TRUE = [(0, 1), (1, 2), (1, 3), (2, 4), (3, 5)]
SAME = [(n + 10, n) for n in range(6)]


def test_found_division(spark):
    assert counts(spark, SAME, [(a + 10, b + 10) for a, b in TRUE], TRUE) == (1, 0, 0)


def test_a_late_fork_counts_through_descendants(spark):
    # the parent's own match is missing and the fork is at its parent: anchor and lineages still meet in one component
    late = [(10, 14), (10, 15)]
    assert counts(spark, [m for m in SAME if m[1] in (0, 4, 5)], late, TRUE) == (1, 1, 0)


def test_missing_daughter_and_split_components(spark):
    assert counts(spark, SAME, [(10, 11), (11, 12), (12, 14), (13, 15)], TRUE) == (0, 0, 1)
    assert counts(spark, [m for m in SAME if m[1] not in (3, 5)], [(10, 11), (11, 12), (11, 99)], TRUE) == (0, 1, 1)


def test_no_true_edges(spark):
    assert counts(spark, [(10, 0)], [(10, 11), (10, 12)], []) == (0, 0, 0)
