"""A cross-section of the registered queries against their SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
import oracle

SF = "/root/testdata/sf0.001"
NAMES = [
    "q_load_measurements", "q_quality_flags", "q_malformed", "q_suspicious", "q_duplicate_flags", "q_duplicate_report",
    "q_missing_profile", "q_percentiles", "q_outlier_candidates", "q_quality_summary", "q_histogram", "q_class_stats",
    "q_associations", "q_pattern_lift", "q_relationships", "q_residual_stats", "q_sensor_aggs", "q_current_band",
    "q_iqr", "q_zscore", "q_detector_metrics", "q_roc_curve", "q_threshold_select", "q_folds", "q_fold_stability",
    "q_error_patterns", "q_sensor_reliability", "q_stage5_features", "q_contextual_sets", "q_hybrid_comparison", "q_final_submission", "q_submission_check",
]


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    assert oracle.compare(entry_point.queries()[name](spark, SF), entry_point.oracle_sql()[name], con) == []


def test_every_sql_text_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
