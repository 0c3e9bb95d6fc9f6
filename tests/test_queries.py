"""Registered queries against their SQL in another engine, over the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

from tracewright import plans

SF = "/root/testdata/sf0.001"
#: One or a few of each family; the full set is compared outside the tests.
NAMES = [
    "JN01_endpoint_lookup", "JN05_radius_join", "JN08_knn_join", "JN10_mutual_nearest", "JN12_distance_anti_join", "JN15_anchored_theta_join", "JN23_greedy_one_to_one", "JN28_as_of_join",
    "GR01_degrees", "GR04_components", "GR12_division_geometry", "GR20_walk_lengths", "GR21_descendants", "GR31_stabilised_coordinates", "GR06_rescue_under_budget", "GR13_division_grafts", "GR15_division_rule_reasons",
    "AG01_edge_confusion", "AG05_error_decomposition", "AG09_grouping_sets", "AG12_percentiles", "AG25_average_precision", "AG26_roc_auc", "AG30_subsample_sensitivity", "AG06_missing_edge_categories", "AG07_sample_metrics", "AG24_best_of_each_parent", "AG28_leave_one_out_fits", "GR09_weak_edge_filter", "GR22_full_context", "SM08_overlapping_chunks", "AG27_swap_threshold", "AG35_residuals_before_after", "VA01_validation_report", "UD15_parent_labels",
    "WN01_line_fit_smoothing", "WN06_neighbour_flow", "WN14_best_so_far", "ST05_group_quota", "SO02_symmetric_difference", "SO06_link_gain_and_loss",
    "PRJ04_clean_probability", "PRJ17_low_margin_blend", "PRJ26_strip_comments", "F08_bytes_little_endian", "F19_array_argmax_unravel",
    "SRC06_csv_exact_header", "SNK01_unified_table", "SNK04_nan_to_null_json", "SNK09_upsert", "VA05_bounds", "SM01_tumbling_window", "SM02_change_events", "SM04_deduplicated_submissions", "SM05_evictions", "SM06_carried_flow", "SM07_look_ahead", "JN16_optimal_assignment", "JN18_assignment_prefiltered", "GR25_guarded_readmission", "GR26_complementary_candidates", "GR17_division_features", "GR14_divergence_horizon", "JN26_reparented_forks",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.8g}") + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    other = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(other.columns)
    columns = sorted(frame.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    at = [other.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in other.fetchall())
    assert ours == theirs


def test_names_are_ids():
    assert all(re.match(r"(JN|GR|AG|WN|ST|SO|PRJ|F|SRC|SNK|SM|VA|UD)\d\d_\w+$", n) for n in plans.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
