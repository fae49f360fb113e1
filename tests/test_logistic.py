"""Logistic regression by Newton steps against Spark's own solver and against slopes of zero."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from gaugesieve.operators import logistic, models
from gaugesieve.plans.measurements import SPEC

SETTINGS = models.lighter(models.CLASSIFIERS["logistic_regression"])


def table(spark, separable):
    r = np.random.default_rng(4)
    a, b = r.normal(size=3000), r.normal(size=3000)
    noise = 0.0 if separable else r.logistic(size=3000)
    hit = 1.5 * a - 0.5 * b + noise > 1.0
    return spark.createDataFrame([(str(i), float(x), float(z), float(x + 1e-3 * z), "Invalid" if h else "Valid")
                                  for i, (x, z, h) in enumerate(zip(a, b, hit))], "rid string, a double, b double, c double, Validity_Label string").repartition(5)


@pytest.mark.parametrize("separable", [False, True])
def test_weights_are_those_of_the_minimum(spark, separable):
    df = table(spark, separable)
    fitted = models.fit_classifier(df, SPEC, ["a", "b", "c"], SETTINGS)
    slopes = [r.gradient for r in models.logistic_gradient(fitted, df, SPEC, SETTINGS).collect()]
    assert len(slopes) == 4 and max(map(abs, slopes)) < 1e-9
    y = models.encode_label(SPEC)
    weights = models.class_weights(df, y)
    data = models._assembled(df, fitted.values(df)).select("features", y.cast("double").alias("label"), F.when(y == 1, weights[1]).otherwise(weights[0]).alias("weight"))
    other = LogisticRegression(maxIter=1000, regParam=1.0 / 3000, standardization=False, tol=1e-12, weightCol="weight").fit(data)
    assert fitted.model.coefficients.toArray() == pytest.approx(other.coefficients.toArray(), abs=1e-4)
    assert fitted.model.intercept == pytest.approx(other.intercept, abs=1e-4)


def test_a_few_passes_do(spark, monkeypatch):
    """Each pass reads all rows once; a search along gradients needs many more."""
    passes, once = [], logistic._pass
    monkeypatch.setattr(logistic, "_pass", lambda *args: passes.append(1) or once(*args))
    models.fit_classifier(table(spark, True), SPEC, ["a", "b", "c"], SETTINGS)
    assert 0 < len(passes) <= 20


def test_gaps_infinities_flags_and_texts_are_filled_as_in_scoring(spark):
    df = table(spark, False).withColumns({
        "a": F.when(F.col("rid").cast("int") % 7 > 0, F.col("a")), "b": F.when(F.col("rid").cast("int") % 11 == 0, float("inf")).otherwise(F.col("b")),
        "c": F.when(F.col("rid").cast("int") % 13 == 0, "n/a").otherwise(F.col("c").cast("string")), "flag": F.col("b") > 0.3})
    fitted = models.fit_classifier(df, SPEC, ["a", "b", "c", "flag"], SETTINGS)
    slopes = [r.gradient for r in models.logistic_gradient(fitted, df, SPEC, SETTINGS).collect()]
    assert len(slopes) == 5 and max(map(abs, slopes)) < 1e-9


def test_one_class_alone_still_fits(spark):
    df = table(spark, False).filter("Validity_Label = 'Valid'")
    fitted = models.fit_classifier(df, SPEC, ["a", "b"], SETTINGS)
    assert fitted.probability(df, "p").agg(F.max("p")).first()[0] == 0.0


def test_a_fit_leaves_nothing_on_disk(spark):
    import os
    from gaugesieve.functions.storage import shared_folder
    df, folder = table(spark, False), shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    models.fit_classifier(df, SPEC, ["a", "b"], models.lighter(models.CLASSIFIERS["Random_Forest"], trees=2, depth=2))
    assert set(os.listdir(folder)) == before
