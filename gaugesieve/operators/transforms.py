"""Fitted transforms: imputation, scaling, normal sensor behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.rowwise import finite, mean_of, number
from gaugesieve.functions.scale import collect_quantiles, quantiles_outside_folds
from gaugesieve.operators.audit import tall
from gaugesieve.operators.features import disagreement_index, regime_code
from gaugesieve.spec import MeasurementSpec


def fit_medians(df: DataFrame, columns) -> dict[str, float | None]:
    """Exact median of the finite values of each column; None for a column without any."""
    found = collect_quantiles(df, {c: finite(number(df, c)) for c in columns}, [0.5])
    return {c: found[c].get(0.5) for c in columns}


def impute(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    """Fill missing and infinite values with fitted numbers; a column fitted on nothing is filled with 0."""
    return df.withColumns({
        c: F.coalesce(finite(number(df, c)), F.lit(float(v if v is not None else 0.0))) for c, v in fills.items()})


def fit_scaling(df: DataFrame, columns) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, a zero deviation counted as 1."""
    row = df.agg(*[a for i, c in enumerate(columns) for a in (
        F.avg(number(df, c)).alias(f"m_{i}"), F.stddev_pop(number(df, c)).alias(f"s_{i}"))]).first()
    return {c: (float(row[f"m_{i}"] or 0.0), float(row[f"s_{i}"] or 0.0) or 1.0)
            for i, c in enumerate(columns)}


def standardize(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (number(df, c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaling.items()})


def min_max(df: DataFrame, column: str, out: str, tiny: float = 1e-5) -> DataFrame:
    """(x - min) / (max - min + tiny) over the whole frame, in one lazy plan."""
    v = number(df, column)
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    scaled = (v - F.col("__ends.lo")) / (F.col("__ends.hi") - F.col("__ends.lo") + tiny)
    return df.withColumn("__ends", ends).withColumn(out, scaled).drop("__ends")


@dataclass
class NormalBehaviourModel:
    """Linear expectation of each sensor given the operating conditions."""

    spec: MeasurementSpec
    medians: dict[str, float]
    weights: dict[str, list[float]] = field(default_factory=dict)
    intercepts: dict[str, float] = field(default_factory=dict)
    label_filtered: bool = True

    def expectation(self, df: DataFrame, sensor: str) -> Column:
        value = F.lit(self.intercepts[sensor])
        for (name, median), weight in zip(self.medians.items(), self.weights[sensor]):
            given = number(df, name) if name in df.columns else F.lit(None).cast("double")
            value = value + F.coalesce(finite(given), F.lit(median)) * F.lit(weight)
        return value

    def transform(self, df: DataFrame) -> DataFrame:
        """Add expectations, residuals and the consistency block. Needs no label."""
        columns: dict[str, Column] = {}
        for s in self.weights:
            expected = self.expectation(df, s)
            residual = number(df, s) - expected if s in df.columns else F.lit(None).cast("double")
            columns |= {f"{s}_Expected": expected, f"{s}_Residual": residual,
                        f"{s}_AbsResidual": F.abs(residual)}
        fitted = df.withColumns(columns)
        observed = [s for s in self.weights if s in df.columns]
        return fitted.withColumns({
            **consistency([F.col(f"{s}_AbsResidual") for s in observed]),
            "p1_sensor_disagreement_index": disagreement_index(df, self.spec),
            "p1_regime_cluster": regime_code(df, self.spec),
        })

    def _fitting_rows(self, df: DataFrame) -> DataFrame:
        if self.label_filtered and self.spec.label_col in df.columns:
            return df.filter(F.col(self.spec.label_col) == self.spec.negative)
        return df

    def performance(self, df: DataFrame) -> DataFrame:
        """R2, mean absolute and root mean square error per sensor on the fitting rows of ``df``."""
        rows = self._fitting_rows(df)
        aggs, entries = [], {}
        for i, s in enumerate(self.weights):
            y = finite(number(rows, s))
            miss = y - self.expectation(rows, s)
            aggs += [F.count(y).alias(f"n_{i}"), F.avg(F.abs(miss)).alias(f"mae_{i}"),
                     F.avg(miss * miss).alias(f"mse_{i}"), F.var_pop(y).alias(f"var_{i}")]
            entries[s] = {
                "Valid_Train_Count": F.col(f"n_{i}"),
                "R2_Score": F.lit(1.0) - F.try_divide(F.col(f"mse_{i}"), F.col(f"var_{i}")),
                "MAE": F.col(f"mae_{i}"), "RMSE": F.sqrt(F.col(f"mse_{i}")),
                "Predictors": F.lit(", ".join(self.medians))}
        return tall(rows.agg(*aggs), entries, "Target_Sensor")


def consistency(absolute_residuals: list[Column]) -> dict[str, Column]:
    """Largest and mean absolute residual of a row and the index 1 / (1 + mean)."""
    if not absolute_residuals:
        nothing = F.lit(None).cast("double")
        return {"p1_max_abs_residual": nothing, "p1_mean_abs_residual": nothing,
                "p1_residual_error": nothing, "p1_consistency_index": nothing}
    largest = F.greatest(*absolute_residuals) if len(absolute_residuals) > 1 else absolute_residuals[0]
    mean = mean_of(absolute_residuals)
    return {"p1_max_abs_residual": largest, "p1_mean_abs_residual": mean, "p1_residual_error": largest,
            "p1_consistency_index": F.lit(1.0) / (F.lit(1.0) + F.coalesce(mean, F.lit(0.0)))}


def fit_normal_behaviour(df: DataFrame, spec: MeasurementSpec, alpha: float = 1.0,
                         min_rows: int = 10) -> NormalBehaviourModel:
    """Ridge regression of every sensor on the conditions, from rows of the negative class only.

    All sensors are fitted in one aggregation: means and covariances per sensor
    come back as one row and the small normal equations are solved from it. Infinite conditions count as missing,
    as they do when the model is applied; rows with an infinite sensor take no part in that sensor's fit.
    """
    model = NormalBehaviourModel(spec, {})
    rows = model._fitting_rows(df)
    predictors = spec.present(df, spec.conditions)
    model.medians = {c: float(m or 0.0) for c, m in fit_medians(rows, predictors).items()}
    x = [F.coalesce(finite(number(rows, c)), F.lit(model.medians[c])) for c in predictors]
    sensors = spec.present(df, spec.sensors)
    size = range(len(x))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for s, name in enumerate(sensors):
        y = finite(number(rows, name))
        seen = [F.when(y.isNotNull(), v) for v in x]
        aggs += [F.count(y).alias(f"n_{s}"), F.avg(y).alias(f"y_{s}")]
        aggs += [F.avg(seen[i]).alias(f"x_{s}_{i}") for i in size]
        aggs += [F.covar_pop(seen[i], y).alias(f"xy_{s}_{i}") for i in size]
        aggs += [F.covar_pop(seen[i], seen[j]).alias(f"xx_{s}_{i}_{j}") for i in size for j in size if i <= j]
    sums = rows.agg(*aggs).first()
    if sums["rows"] < min_rows:
        raise ValueError(f"at least {min_rows} fitting rows are needed, got {sums['rows']}")
    for s, name in enumerate(sensors):
        n = sums[f"n_{s}"]
        if n < min_rows:
            continue
        gram = n * np.array([[sums[f"xx_{s}_{min(i, j)}_{max(i, j)}"] for j in size] for i in size])
        moment = n * np.array([sums[f"xy_{s}_{i}"] for i in size])
        weight = np.linalg.solve(gram + alpha * np.eye(len(x)), moment)
        model.weights[name] = [float(w) for w in weight]
        model.intercepts[name] = float(sums[f"y_{s}"] - weight @ [sums[f"x_{s}_{i}"] for i in size])
    return model


def fit_normal_by_fold(folds: DataFrame, spec: MeasurementSpec, k: int, alpha: float = 1.0, min_rows: int = 10,
                       fold: str = "fold") -> list[NormalBehaviourModel]:
    """For each fold the model of ``fit_normal_behaviour`` on all other folds.

    One pass sums the products of (1, conditions with missing ones as 0, whether they are missing, sensor) per
    fold and sensor; a fold's training sums are the total less its own. As a missing condition counts as the median of the
    training rows, the sums with the indicators put it in afterwards. The medians of all splits are searched together.
    """
    rows = NormalBehaviourModel(spec, {})._fitting_rows(folds)
    predictors, sensors = spec.present(folds, spec.conditions), spec.present(folds, spec.sensors)
    found = quantiles_outside_folds(rows, {c: finite(number(rows, c)) for c in predictors}, 0.5, fold, k)
    given = [finite(number(rows, c)) for c in predictors]
    terms = [F.lit(1.0), *[F.coalesce(v, F.lit(0.0)) for v in given], *[F.when(v.isNull(), 1.0).otherwise(0.0) for v in given]]
    p, size = len(predictors), len(terms)
    narrow = rows.select(F.col(fold).alias("f"), *[t.alias(f"t{i}") for i, t in enumerate(terms)],
                         *[finite(number(rows, s)).alias(f"y{j}") for j, s in enumerate(sensors)])
    aggs = []
    for j in range(len(sensors)):
        y = F.col(f"y{j}")
        seen = [F.when(y.isNotNull(), F.col(f"t{i}")) for i in range(size)]
        aggs += [F.sum(seen[a] * seen[b]).alias(f"xx_{j}_{a}_{b}") for a in range(size) for b in range(a, size)]
        aggs += [F.sum(seen[a] * y).alias(f"xy_{j}_{a}") for a in range(size)]
    sums = {r["f"]: r for r in narrow.groupBy("f").agg(*aggs, F.count(F.lit(1)).alias("rows")).collect()}
    models = []
    for i in range(1, k + 1):
        others = [r for f, r in sums.items() if f != i]
        if sum(r["rows"] for r in others) < min_rows:
            raise ValueError(f"at least {min_rows} fitting rows are needed")
        medians = {c: float(found[i - 1][c] or 0.0) for c in predictors}
        model = NormalBehaviourModel(spec, medians)
        # Row r of ``fill`` makes condition r of the terms: its value plus the median where it is missing.
        fill = np.hstack([np.zeros((p, 1)), np.eye(p), np.diag(list(medians.values()))]) if p else np.zeros((0, size))
        for j, name in enumerate(sensors):
            def total(prefix, *at):
                return sum(r[f"{prefix}_{j}_" + "_".join(map(str, at))] or 0.0 for r in others)

            products = np.array([[total("xx", min(a, b), max(a, b)) for b in range(size)] for a in range(size)])
            with_y = np.array([total("xy", a) for a in range(size)])
            n = products[0, 0]
            if n < min_rows:
                continue
            means = fill @ products[:, 0] / n
            gram = fill @ products @ fill.T - n * np.outer(means, means)
            moment = fill @ with_y - means * with_y[0]
            weight = np.linalg.solve(gram + alpha * np.eye(p), moment)
            model.weights[name] = [float(w) for w in weight]
            model.intercepts[name] = float(with_y[0] / n - weight @ means)
        models.append(model)
    return models
