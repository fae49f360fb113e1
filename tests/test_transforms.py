import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugesieve.operators import classstats, detectors, features, transforms
from gaugesieve.plans.measurements import SPEC, measurements

SF = "/root/testdata/sf0.001"


def test_median_of_fitting_rows_only(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0, None)], "x double")
    assert transforms.fit_medians(df, ["x"]) == {"x": 2.5}
    other = spark.createDataFrame([(None,), (100.0,)], "x double")
    assert [r.x for r in transforms.impute(other, {"x": 2.5}).collect()] == [2.5, 100.0]
    assert transforms.fit_medians(other.filter("x IS NULL"), ["x"]) == {"x": None}


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert transforms.fit_scaling(df, ["x", "c"]) == {"x": (2.0, 1.0), "c": (5.0, 1.0)}


def test_ridge_matches_the_closed_form(spark):
    df = measurements(spark, SF)
    model = transforms.fit_normal_behaviour(df, SPEC)
    valid = df.filter("Validity_Label = 'Valid'").toPandas()
    x_all = valid[list(SPEC.conditions)].to_numpy()
    performance = {r.Target_Sensor: r for r in model.performance(df).collect()}
    for sensor in SPEC.sensors:
        seen = valid[sensor].notna().to_numpy()
        x, y = x_all[seen], valid[sensor].to_numpy()[seen]
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
        assert model.weights[sensor] == pytest.approx(list(w), rel=1e-8)
        assert model.intercepts[sensor] == pytest.approx(y.mean() - x.mean(0) @ w, rel=1e-8)
        miss = yc - xc @ w
        assert performance[sensor].R2_Score == pytest.approx(1 - (miss @ miss) / (yc @ yc))
        assert performance[sensor].MAE == pytest.approx(np.abs(miss).mean())
        assert performance[sensor].RMSE == pytest.approx(np.sqrt((miss ** 2).mean()))


def test_scoring_needs_no_label_and_keeps_rows(spark):
    df = measurements(spark, SF)
    model = transforms.fit_normal_behaviour(df, SPEC)
    out = model.transform(df.drop("Validity_Label", "Reference_Parameter"))
    assert out.count() == df.count()
    assert out.filter("p1_consistency_index <= 0 OR p1_consistency_index > 1").count() == 0


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        transforms.fit_normal_behaviour(measurements(spark, SF).limit(3), SPEC)


def test_row_aggregates_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None, 4.0, None), (None, None, None, None), (2.0, 2.0, 2.0, 8.0)],
                               "Sensor_S1 double, Sensor_S2 double, Sensor_S3 double, Sensor_S4 double")
    rows = df.select(*[c.alias(n) for n, c in features.sensor_aggregates(df, SPEC).items()]).collect()
    assert rows[0].sensor_mean_S1_S2_S3_S4 == 2.5 and rows[0].sensor_median_S1_S2_S3 == 2.5
    assert rows[0].sensor_std_S1_S2_S3 == pytest.approx(np.std([1, 4], ddof=1))
    assert rows[1].sensor_mean_S1_S2_S3 is None and rows[1].sensor_std_S1_S2_S3_S4 is None
    assert rows[2].sensor_median_S1_S2_S3_S4 == 2.0


def test_planted_outlier_and_constant_columns(spark):
    values = list(np.random.default_rng(0).normal(100, 5, 99))
    df = spark.createDataFrame([(0, 500.0, 1.0)] + [(k + 1, float(v), 1.0) for k, v in enumerate(values)],
                               "id long, Applied_Voltage_kV double, Load_Current_A double")
    for detect, name in ((detectors.iqr_detector, "iqr"), (detectors.zscore_detector, "zscore")):
        out = {r.id: r for r in detect(df, SPEC).collect()}
        assert out[0][f"{name}_pred"] == 1 and out[0][f"{name}_score"] == max(r[f"{name}_score"] for r in out.values())


def test_empty_class_gives_no_effect_size(spark):
    df = measurements(spark, SF).filter("Validity_Label = 'Valid'")
    rows = classstats.label_associations(df, SPEC, ["Sensor_S1"]).collect()
    assert rows[0].Cohens_D_EffectSize is None and rows[0].Spearman_Corr is None
    assert classstats.class_balance(df, SPEC).first().ImbalanceRatio is None


def test_id_and_target_never_in_a_matrix(spark):
    df = measurements(spark, SF)
    assert not {"rid", "Test_ID", "Validity_Label", "Reference_Parameter"} & set(features.matrix_columns(df, SPEC))
    for name in ("Test_ID", "absent"):
        with pytest.raises(ValueError):
            features.feature_matrix(df, SPEC, [name])


def test_scratch_scope_deletes_what_was_stored_in_it(spark):
    import os

    from gaugesieve.functions import storage
    outside = storage.stored(spark.range(3))
    with storage.scratch(spark):
        inside = storage.stored(spark.range(5))
        with storage.scratch(spark):
            inner = storage.stored(spark.range(2))
            assert inner.count() == 2
        files = inner.inputFiles(), inside.inputFiles()
        assert inside.count() == 5 and not os.path.exists(files[0][0].removeprefix("file://"))
    assert not os.path.exists(files[1][0].removeprefix("file://")) and outside.count() == 3
