"""Logistic regression on rows that no machine holds: Newton's method, one pass of sums per step.

The loss is the weighted log loss and half the squares of the slopes, the intercept not penalised. It is convex with one minimum,
so where the slopes of the loss vanish the weights are those of any other exact solver. A pass sends one gradient and one matrix per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugesieve.functions.rowwise import number

SETTLED = 1e-14  # of the total weight: what a step may still promise to gain when the search ends
HALVINGS = 40


def _sums(beta: np.ndarray, fills: np.ndarray, means: np.ndarray, spreads: np.ndarray, weights: tuple[float, float]):
    """Per partition the weighted log loss, its gradient and its second derivatives at ``beta``, the intercept first.

    The columns of a batch are the label and the features as they are; missing and infinite values are filled here, and all are scaled.
    """
    size = len(beta)

    def run(batches):
        loss, slope, bend = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.ones((n, size))
            for j in range(1, size):
                v = batch.column(j).to_numpy(zero_copy_only=False)
                x[:, j] = (np.where(np.isfinite(v), v, fills[j - 1]) - means[j - 1]) / spreads[j - 1]
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            w = np.where(y == 1, weights[1], weights[0])
            margin = x @ beta
            loss += float(w @ (np.logaddexp(0.0, margin) - y * margin))
            p = np.exp(-np.logaddexp(0.0, -margin))
            slope += x.T @ (w * (p - y))
            bend += x.T @ (x * (w * p * np.exp(-np.logaddexp(0.0, margin)))[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tolist()]), pa.array([bend.ravel().tolist()])], ["loss", "slope", "bend"])
    return run


def _pass(rows: DataFrame, beta: np.ndarray, *known) -> tuple[float, np.ndarray, np.ndarray]:
    found = rows.mapInArrow(_sums(beta, *known), "loss double, slope array<double>, bend array<double>").toArrow()
    size = len(beta)
    penalty = np.append(0.0, np.ones(size - 1))
    slope = found.column("slope").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)
    bend = found.column("bend").combine_chunks().flatten().to_numpy().reshape(-1, size, size).sum(axis=0)
    loss = float(np.sum(found.column("loss").to_numpy())) + 0.5 * float(penalty @ (beta * beta))
    return loss, slope + penalty * beta, bend + np.diag(penalty)


def _plain(df: DataFrame, name: str) -> Column:
    """The column as a double; gaps, NaN and infinities are left to the sums."""
    return F.col(f"`{name}`") if isinstance(df.schema[name].dataType, T.DoubleType) else number(df, name)


def fit_logistic(df: DataFrame, y: Column, columns: list[str], fills: dict, scaling: dict, weights: dict[int, float],
                 iterations: int) -> LogisticRegressionModel | None:
    """The model of the filled and scaled columns, in at most ``iterations`` steps; None where the label ``y`` has one value only.

    ``df`` should be stored: each step reads it. Only its columns leave the scan, the arithmetic is done on whole batches.
    """
    rows = df.select(y.alias("__y"), *[_plain(df, c).alias(f"__x{i}") for i, c in enumerate(columns)])
    counts = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    if len(counts) < 2:
        return None
    known = (np.array([float(fills.get(c) or 0.0) for c in columns]), *[np.array([scaling[c][k] for c in columns]) for k in (0, 1)],
             (weights[0], weights[1]))
    total = sum(n * weights[k] for k, n in counts.items())
    beta = np.zeros(1 + len(columns))
    beta[0] = np.log(counts[1] * weights[1] / (counts[0] * weights[0]))
    at = _pass(rows, beta, *known)
    for _ in range(iterations):
        loss, slope, bend = at
        step = np.linalg.solve(bend, slope)
        gain = float(slope @ step)
        if gain <= SETTLED * total:
            beta = beta - step
            break
        for half in range(HALVINGS):
            tried = beta - step / 2 ** half
            at = _pass(rows, tried, *known)
            if at[0] <= loss - 1e-4 * gain / 2 ** half or gain / 2 ** half <= 1e-12 * abs(loss):
                break
        beta = tried
    jvm = df.sparkSession._jvm
    slopes = _py2java(df.sparkSession.sparkContext, Vectors.dense(beta[1:].tolist()))
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("logreg")
    return LogisticRegressionModel(jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, slopes, float(beta[0])))
