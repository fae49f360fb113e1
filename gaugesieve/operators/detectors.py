"""Rule-based and statistical detectors: each adds a 0/1 prediction and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.rowwise import any_of, count_true, number, true_or_false
from gaugesieve.functions.scale import exact_quantiles
from gaugesieve.operators.flags import SCORED_FLAGS
from gaugesieve.spec import MeasurementSpec


RULE_COLUMNS = ("data_quality_issue", "duplicate_measurement_pair")


def with_prediction(df: DataFrame, pred: Column, score: Column, name: str) -> DataFrame:
    return df.withColumns({f"{name}_pred": pred.cast("int"), f"{name}_score": score.cast("double")})


def rule_detector(df: DataFrame, rule: str = "definite_issue", name: str = "rule") -> DataFrame:
    """Predict from the quality flags; the probability is 0 or 1."""
    used = {"definite_issue": ["data_quality_issue"],
            "definite_plus_duplicate": ["data_quality_issue", "duplicate_measurement_pair"]}
    if rule not in used:
        raise ValueError(f"unknown rule {rule!r}")
    hit = any_of([F.col(c) for c in used[rule] if c in df.columns])
    return with_prediction(df, hit, hit.cast("double"), name)


def quality_detector(df: DataFrame, name: str = "quality") -> DataFrame:
    """Score by the number of raised flags; the summary flag counts as one more."""
    flags = [F.col(f) for f in SCORED_FLAGS if f in df.columns]
    score = count_true(flags) if flags else F.lit(0)
    return with_prediction(df, score > 0, score, name)


def iqr_detector(df: DataFrame, spec: MeasurementSpec, columns=None, name: str = "iqr",
                 reach: float = 1.5) -> DataFrame:
    """Score by the number of features outside their quartile fences in this very frame."""
    columns = spec.present(df) if columns is None else list(columns)
    quartiles = exact_quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.75])
    fences = quartiles.groupBy("feature").agg(F.min("quantile").alias("q1"), F.max("quantile").alias("q3"))
    # One entry per feature: the map is as wide as the column list.
    bounds = fences.agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("q1", "q3"))))).scalar()
    data = df.withColumn("__fences", bounds)

    def outside(c):
        q1, q3 = F.col("__fences")[c]["q1"], F.col("__fences")[c]["q3"]
        iqr, v = q3 - q1, number(df, c)
        return true_or_false((iqr > 0) & ((v < q1 - reach * iqr) | (v > q3 + reach * iqr)))

    score = count_true([outside(c) for c in columns])
    return with_prediction(data, score > 0, score, name).drop("__fences")


def zscore_detector(df: DataFrame, spec: MeasurementSpec, threshold: float = 3.0, columns=None,
                    name: str = "zscore") -> DataFrame:
    """Score by the largest absolute z over the features, sample deviation, 0 deviation as 1.

    A feature that holds an infinity has no finite mean and deviation and decides nothing.
    """
    columns = spec.present(df) if columns is None else list(columns)
    stats = df.agg(F.struct(*[
        a for i, c in enumerate(columns) for a in (
            F.avg(number(df, c)).alias(f"m{i}"), F.stddev_samp(number(df, c)).alias(f"s{i}"))])).scalar()
    data = df.withColumn("__z", stats)
    z = [F.nanvl(F.abs((number(df, c) - F.col(f"__z.m{i}"))
                       / F.when(F.col(f"__z.s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"__z.s{i}"))), F.lit(None).cast("double"))
         for i, c in enumerate(columns)]
    score = F.coalesce(F.greatest(*z) if len(z) > 1 else z[0], F.lit(0.0))
    return with_prediction(data, score > threshold, score, name).drop("__z")


def residual_detector(df: DataFrame, max_residual: float = 3.0, min_consistency: float = 0.1,
                      name: str = "residual") -> DataFrame:
    largest = F.coalesce(number(df, "p1_max_abs_residual"), F.lit(0.0))
    index = F.coalesce(number(df, "p1_consistency_index"), F.lit(1.0))
    return with_prediction(df, (largest > max_residual) | (index < min_consistency), largest, name)


def present_keys(df: DataFrame, spec: MeasurementSpec) -> list[str]:
    """The row key, if the frame has all of it."""
    return list(spec.row_key) if set(spec.row_key) <= set(df.columns) else []


def fit_detector(train: DataFrame, spec: MeasurementSpec, method: str = "isolation_forest",
                 columns=None, **options):
    """Fit an unsupervised detector; the result has ``score(df)`` and ``detect(df, name)``."""
    columns = spec.present(train) if columns is None else list(columns)
    if method == "isolation_forest":
        from gaugesieve.operators.iforest import fit_isolation_forest
        return fit_isolation_forest(train, columns, **{"keys": present_keys(train, spec)} | options)
    if method == "lof":
        from gaugesieve.operators.lof import fit_lof
        return fit_lof(train, columns, **options)
    raise ValueError(f"unknown method {method!r}")
