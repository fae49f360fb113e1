import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugesieve.operators import evaluate, submit
from gaugesieve.plans.measurements import SPEC

ROWS = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.4), (1, 0.4), (0, 0.1)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "y int, score double")


def test_areas_with_ties(spark):
    row = evaluate.ranking_metrics(frame(spark)).first()
    assert row.ROC_AUC == pytest.approx((3 + 2 + 1.5) / 9)
    assert row.PR_AUC == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)


def test_single_class_has_no_area(spark):
    row = evaluate.ranking_metrics(frame(spark, [(0, 0.1), (0, 0.2)])).first()
    assert row.ROC_AUC is None and row.PR_AUC is None


def test_sweep_grid_and_sums(spark):
    sweep = evaluate.threshold_sweep(frame(spark), "score", F.col("y")).collect()
    assert sorted(r.Threshold for r in sweep) == list(evaluate.THRESHOLDS)
    assert all(r.TP + r.TN + r.FP + r.FN == 6 for r in sweep)
    at = next(r for r in sweep if r.Threshold == 0.4)
    assert (at.TP, at.FP, at.Confusion_Matrix) == (3, 2, "[[1, 2], [0, 3]]")


def test_sweep_rejects_missing_probability(spark):
    with pytest.raises(PySparkException, match="missing probability"):
        evaluate.threshold_sweep(frame(spark, [(1, None)]), "score", F.col("y")).collect()


def test_selection_prefers_recall_then_low_threshold(spark):
    sweep = spark.createDataFrame(
        [(0.3, 0.9, 1.0, 0.8, 5), (0.4, 0.9, 1.0, 0.8, 5), (0.5, 0.9005, 0.9, 0.9, 2), (0.6, 0.5, 0.4, 1.0, 0)],
        "Threshold double, Invalid_F1 double, Invalid_Recall double, Invalid_Precision double, FP long")
    row = evaluate.select_threshold(sweep).first()
    assert (row.selected_threshold, row.candidate_count, row.candidate_thresholds) == (0.3, 3, "0.30, 0.40, 0.50")


def test_zero_division_is_zero(spark):
    row = evaluate.evaluate_detectors(spark.createDataFrame([("m", 1, 0)], "method string, y int, pred int"), ranking=False).first()
    assert (row.Invalid_Precision, row.Invalid_Recall, row.Invalid_F1) == (0.0, 0.0, 0.0)


def test_no_errors_gives_one_row_saying_so(spark):
    errors = spark.createDataFrame([], "error_type string, operating_regime string, high_residual_flag boolean, "
                                       "high_current_flag boolean, high_voltage_flag boolean, data_quality_issue boolean")
    rows = evaluate.error_patterns(errors, SPEC).collect()
    assert sorted((r.Error_Type, r.Pattern, r.Count) for r in rows) == [("FN", "None", 0), ("FP", "None", 0)]


def test_submission_checks(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "rid string")
    good = spark.createDataFrame([("a", "Valid"), ("b", "Invalid")], "rid string, Validity_Label string")
    submit.check_submission(good, expected, SPEC)
    for bad in ([("a", "Valid")], [("a", "Valid"), ("a", "Valid")], [("a", "Valid"), ("b", None)],
                [("a", "Valid"), ("b", "Maybe")], [("a", "Valid"), (None, "Valid")]):
        with pytest.raises(ValueError):
            submit.check_submission(spark.createDataFrame(bad, good.schema), expected, SPEC)
    with pytest.raises(ValueError):
        submit.check_submission(good.select("Validity_Label", "rid"), expected, SPEC)
    values = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "rid string, Reference_Parameter double")
    final = submit.final_submission(expected, values, good, SPEC)
    assert final.columns == ["rid", "Predicted_Reference_Parameter", "Validity_Label"] and final.count() == 2
    with pytest.raises(ValueError):
        submit.final_submission(expected, values.limit(1), good, SPEC)
