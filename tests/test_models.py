import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugesieve.functions.storage import durable
from gaugesieve.operators import evaluate, flags, importance, models, persist, submit, transforms
from gaugesieve.plans.measurements import SPEC, fitting_rows, measurements, scoring_rows
from gaugesieve.sources.io import read_result

SF = "/root/testdata/sf0.001"
SMALL = models.lighter(models.CLASSIFIERS["Random_Forest"], trees=10, depth=6)


def test_folds_are_stratified_and_stable(spark):
    df = measurements(spark, SF)
    one, many = (models.stratified_folds(df.repartition(n), SPEC).select("rid", "Validity_Label", "fold") for n in (1, 13))
    assert one.exceptAll(many).count() == 0 and one.count() == df.count()
    sizes = one.groupBy("Validity_Label").pivot("fold").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in sizes)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert models.class_weights(df, F.col("y")) == {1: 2.0, 0: pytest.approx(2 / 3)}


def test_out_of_fold_table(spark):
    df = measurements(spark, SF)
    oof = models.out_of_fold(df, SPEC, SMALL, "Set_D_Full_Stage5", k=3)
    rows = oof.select("rid", "fold", "OOF_Rank", "true_invalid", F.col("oof_probability_invalid").alias("p")).collect()
    assert len({r.rid for r in rows}) == len(rows) == df.count()
    assert sorted(r.OOF_Rank for r in rows) == list(range(1, len(rows) + 1))
    assert all(0.0 <= r.p <= 1.0 for r in rows)
    long = oof.select("model_name", "feature_set_name", F.col("true_invalid").alias("y"),
                      (F.col("oof_probability_invalid") >= 0.5).cast("int").alias("pred"),
                      F.col("oof_probability_invalid").alias("score"))
    best = evaluate.evaluate_detectors(long, ["model_name", "feature_set_name"]).first()
    assert best.Invalid_F1 > 0.6 and best.ROC_AUC > 0.8
    full = models.set_columns("Set_D_Full_Stage5", df, oof.drop("fold", "model_name", "feature_set_name", "true_invalid",
                                                              "oof_probability_invalid", "OOF_Rank"), SPEC)
    assert len(full) == 59


def test_oof_check_rejects_faults(spark):
    df = spark.createDataFrame([("a", "Valid", 1, 0.5), ("a", "Valid", 1, 0.5)],
                               "rid string, Validity_Label string, fold int, oof_probability_invalid double")
    with pytest.raises(ValueError):
        evaluate.check_oof(df, SPEC)
    with pytest.raises(ValueError):
        evaluate.check_oof(df.drop("fold"), SPEC)


def test_hybrid_detector_and_importance(spark):
    df = measurements(spark, SF)
    detector = models.FinalHybridDetector(SPEC, SMALL, forest_trees=20).fit(fitting_rows(df))
    test = scoring_rows(df)
    out = detector.diagnose(test)
    assert out.count() == test.count()
    odd = out.filter("(Final_Validity_Label = 'Invalid') <> (Model_Invalid OR Hard_Quality_Evidence)")
    assert odd.count() == 0 and out.filter("Invalid_Probability < 0 OR Invalid_Probability > 1").count() == 0
    reasons = {r[0] for r in out.select("Reason_Evidence").distinct().collect()}
    assert reasons <= {"deterministic_corruption", "supervised_probability", "model_valid"}


def test_permutation_importance_finds_the_informative_feature(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("rid"), (F.col("id") % 2).cast("double").alias("good"),
        (F.xxhash64("id") % 10).cast("double").alias("noise"),
        F.when(F.col("id") % 2 == 1, "Invalid").otherwise("Valid").alias("Validity_Label"))
    fitted = models.fit_classifier(df, SPEC, ["noise", "good"], SMALL)
    rows = {r.feature_name: r for r in models.permutation_importance(fitted, df, SPEC, repeats=3, block_rows=100).collect()}
    assert rows["good"].importance_mean > 0.2 and abs(rows["noise"].importance_mean) < 0.05


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        models.FinalHybridDetector(SPEC, threshold=1.5)
    with pytest.raises(RuntimeError):
        models.FinalHybridDetector(SPEC).predict(measurements(spark, SF))
    with pytest.raises(ValueError):
        models.fit_classifier(measurements(spark, SF), SPEC, ["Test_ID"], SMALL)


def test_baseline_query_returns_all_reports(spark):
    from gaugesieve.plans import catalog
    got = catalog.queries()["q_baselines"](spark, "/root/testdata/sf0.001")
    assert {r.report for r in got.select("report").distinct().collect()} == {"predictions", "metrics", "errors", "regimes"}


def test_final_validity_query_uses_the_default_forest():
    from gaugesieve.plans import checks_models
    default = models.FinalValidityClassifier.__dataclass_fields__["config"].default
    assert checks_models.FINAL_FOREST == models.lighter(default, max_rows=checks_models.FIT_ROWS)


@pytest.fixture(scope="module")
def small(spark):
    """Features of some of the smallest table's rows."""
    df = measurements(spark, SF).filter(f"{SPEC.id_col} % 8 = 0")
    return df, durable(models.screening_features(df, SPEC)[0])


def test_importance_by_the_index_equals_full_rescoring(spark, small):
    df, features = small
    columns = models.full_columns(df, features, SPEC)
    fitted = models.fit_classifier(features, SPEC, columns, SMALL)
    keys, y = [F.col("rid")], models.encode_label(SPEC)
    grouped = importance._blocks(features, keys, y, fitted.values(features), 1, 300)
    by_index = importance.forest_counts(importance.trees_of(fitted.model, spark), grouped, 2, 0.3, 1)
    whole = importance.whole_counts(fitted.model, grouped, 2, 0.3, 1)
    names = ["repeat", "j", "TP", "FP", "FN", "TN"]
    got, want = (sorted(tuple(r[n] for n in names) for r in c.collect()) for c in (by_index, whole))
    assert len(got) == 1 + 2 * len(columns) and got == want
    assert len({r[2:] for r in got}) > 3


def test_flags_of_all_folds_equal_those_of_each_part(spark, small):
    some = small[0].withColumn("rid", F.when(F.col("rid") < "4", F.lit("same")).otherwise(F.col("rid")))
    df = some.unionByName(some.filter(f"{SPEC.id_col} % 7 = 0")).unionByName(small[0].filter(f"{SPEC.id_col} % 5 = 0"))
    folds = durable(models.stratified_folds(df, SPEC, 3))
    split = flags.quality_flags_by_fold(folds, SPEC, 3)
    for i in (1, 2, 3):
        for part, where in zip(split(i), (F.col("fold") != i, F.col("fold") == i)):
            direct = flags.quality_flags(folds.filter(where).drop("fold"), SPEC)
            assert part.columns == direct.columns
            assert part.exceptAll(direct).count() == 0 == direct.exceptAll(part).count()
    assert split(1)[0].filter("duplicate_full_row").count() > 0


def test_normal_behaviour_of_all_folds_equals_direct_fits(spark, small):
    df = small[0].withColumn(SPEC.voltage, F.expr(f"CASE WHEN {SPEC.id_col} % 24 = 0 THEN NULL ELSE {SPEC.voltage} END"))
    folds = durable(models.stratified_folds(df, SPEC, 3))
    for i, model in enumerate(transforms.fit_normal_by_fold(folds, SPEC, 3), 1):
        direct = transforms.fit_normal_behaviour(folds.filter(F.col("fold") != i), SPEC)
        assert model.medians == direct.medians and model.weights.keys() == direct.weights.keys()
        for s in direct.weights:
            assert model.weights[s] == pytest.approx(direct.weights[s], rel=1e-7)
            assert model.intercepts[s] == pytest.approx(direct.intercepts[s], rel=1e-7, abs=1e-7)


def test_matrix_grid_fits_what_single_fits_do(spark, small):
    frame = small[1]
    config = models.lighter(models.CLASSIFIERS["logistic_regression"], iterations=20)
    oof = models.cross_validate_matrix(frame, SPEC, list(SPEC.features), config, k=3)
    folds = models.stratified_folds(frame, SPEC, 3)
    fitted = models.fit_classifier(folds.filter("fold <> 2"), SPEC, list(SPEC.features), config)
    direct = {r.rid: r.p for r in fitted.probability(folds.filter("fold = 2"), "p").collect()}
    got = {r.rid: r.oof_probability_invalid for r in oof.filter("fold = 2").collect()}
    assert got.keys() == direct.keys() and all(got[k] == pytest.approx(direct[k], abs=1e-9) for k in got)
    assert oof.count() == frame.count()


def test_grids_have_all_configurations(spark, small):
    tiny = {n: models.lighter(c, trees=2, depth=2, iterations=2) for n, c in models.CLASSIFIERS.items()}
    table = models.evaluate_grid(small[0], SPEC, "baseline", k=2, configs=tiny)
    assert table.count() == 8 and table.filter("model_name LIKE 'rule_%'").count() == 2
    assert models.evaluate_grid(small[0], SPEC, "final", k=2, configs=tiny).count() == 12
    with pytest.raises(ValueError):
        models.evaluate_grid(small[0], SPEC, "none")


def test_best_of_a_saved_comparison(spark, small, tmp_path):
    df, folder = small[0], str(tmp_path / "saved")
    first, how = models.resolve_best(df, SPEC, folder, "rules")
    assert how == "miss"
    assert models.resolve_best(df.repartition(3), SPEC, folder, "rules")[1] == "hit"
    assert models.resolve_best(df, SPEC, folder, "rules", k=3)[1] == "stale"
    assert models.resolve_best(df.filter(f"{SPEC.id_col} % 16 = 0"), SPEC, folder, "rules")[1] == "stale"
    assert models.resolve_best(df.withColumn("more", F.lit(1)), SPEC, folder, "rules")[1] == "stale"
    again, how = models.resolve_best(df, SPEC, folder, "rules")
    assert how == "hit" and again.collect() == first.collect()


def test_logistic_weights_are_optimal_and_others_are_not(spark, small):
    config = models.CLASSIFIERS["logistic_regression"]
    fitted = models.fit_classifier(small[1], SPEC, list(SPEC.features), config)
    slopes = models.logistic_gradient(fitted, small[1], SPEC, config).collect()
    assert [r.feature for r in slopes] == ["(intercept)", *SPEC.features]
    assert all(abs(r.gradient) < 1e-3 for r in slopes)
    early = models.lighter(config, iterations=1)
    rough = models.fit_classifier(small[1], SPEC, list(SPEC.features), early)
    assert max(abs(r.gradient) for r in models.logistic_gradient(rough, small[1], SPEC, early).collect()) > 1e-2


@pytest.mark.parametrize("kind", ["hybrid", "validity"])
def test_saved_detectors_score_the_same(spark, small, tmp_path, kind):
    test = small[0].drop(SPEC.label_col, SPEC.target_col)
    settings = {"config": SMALL} | ({"forest_trees": 5, "feature_set": "Set_E_Stage5_AnomalyScore"} if kind == "hybrid" else {})
    model = persist.DetectorEstimator(SPEC, kind, **settings).fit(small[0])
    path = str(tmp_path / "model")
    model.write().save(path)
    loaded = persist.DetectorModel.load(path)
    a, b = (sorted(map(str, m.transform(test).collect())) for m in (model, loaded))
    assert a == b and len(a) == test.count()
    with pytest.raises(Exception):
        model.write().save(path)
    with pytest.raises(ValueError):
        persist.DetectorEstimator(SPEC, "none")


class Fixed:
    def __init__(self, label):
        self.label = label

    def predict(self, df):
        return df.select("rid", F.lit(self.label).alias(SPEC.label_col))


def test_submission_is_written_as_checked(spark, small, tmp_path):
    test, path = small[0].drop(SPEC.label_col), str(tmp_path / "out")
    rows = submit.build_submission(Fixed("Valid"), test, SPEC, path)
    published = read_result(spark, path, rows.schema, "csv")
    assert sorted(published.collect()) == sorted(rows.collect()) and published.count() == test.count()
    with pytest.raises(ValueError):
        submit.build_submission(Fixed("Perhaps"), test, SPEC, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    lossy = rows.withColumn(SPEC.label_col, F.lit("a\nb"))  # a line end that the plain CSV reader takes for the end of a row
    with pytest.raises(ValueError):
        submit.publish(lossy, str(tmp_path / "lossy"))


def test_fits_on_rows_drawn_before_are_the_same(spark, small):
    """Several fits of a fold share the rows they see, drawn once."""
    df, _ = small
    config = models.lighter(models.CLASSIFIERS["Logistic_Regression"], max_rows=150)
    drawn = models.fitting_sample(df, SPEC, config, 42).persist()
    own = models.fit_classifier(df, SPEC, list(SPEC.features), config)
    shared = models.fit_classifier(df, SPEC, list(SPEC.features), config, drawn=drawn)
    assert drawn.count() < df.count() and shared.model.coefficients == own.model.coefficients and shared.fills == own.fills
    slopes = models.logistic_gradient(shared, df, SPEC, config, drawn=drawn)
    assert all(abs(r.gradient) < 1e-3 for r in slopes.collect())


def test_bounds_of_a_leaf_tell_who_stays():
    tree = importance.Tree(np.array([0, -1, 1, 0, -1, -1, -1]), np.array([1.0, 0, 2.0, 3.0, 0, 0, 0]),
                           np.array([[1, 2], [-1, -1], [3, 6], [4, 5], [-1, -1], [-1, -1], [-1, -1]]), np.zeros(7))
    low, high = tree.bounds(2)
    x = np.random.default_rng(2).uniform(0, 4, (500, 2))
    leaf = tree.leaves(x)
    assert ((low[leaf] < x) & (x <= high[leaf])).all()
    assert [(low[4, 0], high[4, 0], high[4, 1]), (low[5, 0], high[5, 0], high[5, 1])] == [(1.0, 3.0, 2.0), (3.0, np.inf, 2.0)]
