"""Classifiers on pyspark.ml, strictly fold-isolated validation, final detectors."""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from gaugesieve.functions import metrics as M
from gaugesieve.functions.rowwise import finite, number
from gaugesieve.functions.scale import collect_quantiles, quantiles_outside_folds, rank_by_digest
from gaugesieve.functions.storage import durable, outlasting, scratch, stored
from gaugesieve.operators.audit import active_features
from gaugesieve.operators.detectors import RULE_COLUMNS, present_keys, rule_detector
from gaugesieve.operators.evaluate import check_oof, evaluate_detectors
from gaugesieve.operators.features import row_features, with_context
from gaugesieve.operators.flags import (
    HARD_FLAGS, REPORTED_FLAGS, SCORED_FLAGS, decode_label, encode_label, hard_mask, quality_flags, quality_flags_by_fold,
)
from gaugesieve.operators.iforest import IsolationForestModel, fit_isolation_forest, with_fold_anomaly
from gaugesieve.operators.importance import permuted_f1
from gaugesieve.operators.logistic import fit_logistic
from gaugesieve.operators.transforms import NormalBehaviourModel, fit_medians, fit_normal_behaviour, fit_normal_by_fold, fit_scaling
from gaugesieve.spec import MeasurementSpec

ANOMALY_COLUMN = "isolation_forest_score"

# Feature set names, residual features, locked threshold.
FEATURE_SETS = ("Set_A_Raw", "Set_B_Raw_Quality", "Set_C_Raw_Residuals", "Set_D_Full_Stage5",
                "Set_E_Stage5_AnomalyScore")
RESIDUAL_FEATURES = (
    "Sensor_S1_Residual", "Sensor_S2_Residual", "Sensor_S3_Residual", "Sensor_S4_Residual",
    "p1_max_abs_residual", "p1_mean_abs_residual", "p1_consistency_index",
    "p1_sensor_disagreement_index", "p1_regime_cluster",
)
SOFT_EVIDENCE = ("p1_max_abs_residual", "p1_mean_abs_residual", "p1_consistency_index",
                 "p1_sensor_disagreement_index")
LOCKED_THRESHOLD = 0.40
# End of fixed values.


@dataclass(frozen=True)
class ClassifierConfig:
    name: str
    kind: str
    balanced: bool = True
    trees: int = 200
    depth: int = 12
    min_instances: int = 2
    iterations: int = 200
    anomaly_feature: bool = False
    max_rows: int | None = None


# Depth 30 is the deepest Spark grows; it stands for unbounded trees.
CLASSIFIERS = {
    "Logistic_Regression": ClassifierConfig("Logistic_Regression", "logistic", iterations=1000),
    "Random_Forest": ClassifierConfig("Random_Forest", "forest"),
    "Hist_Gradient_Boosting": ClassifierConfig("Hist_Gradient_Boosting", "boosting", depth=5),
    "logistic_regression": ClassifierConfig("logistic_regression", "logistic", iterations=1000),
    "logistic_regression_unweighted": ClassifierConfig(
        "logistic_regression_unweighted", "logistic", balanced=False, iterations=1000),
    "random_forest": ClassifierConfig("random_forest", "forest", depth=30, min_instances=1),
    "random_forest_100": ClassifierConfig("random_forest_100", "forest", trees=100, depth=30, min_instances=1),
    "random_forest_anomaly": ClassifierConfig(
        "random_forest_anomaly", "forest", depth=30, min_instances=1, anomaly_feature=True),
    "gradient_boosting": ClassifierConfig(
        "gradient_boosting", "boosting", balanced=False, depth=5, iterations=100),
}


# The models and feature sets of each grid.
GRIDS = {
    "screening": (("Logistic_Regression", "Random_Forest", "Hist_Gradient_Boosting"), FEATURE_SETS),
    "baseline": (("logistic_regression", "random_forest_100", "gradient_boosting"), ("Anomaly_A", "Final_A")),
    "final": (("logistic_regression", "random_forest", "random_forest_anomaly", "gradient_boosting"),
              ("Final_A", "Final_B", "Final_C")),
    "rules": ((), ()),
}
# End of fixed values.


def class_weights(df: DataFrame, y: Column) -> dict[int, float]:
    """n / (2 * class size) for each class that occurs."""
    counts = {r["y"]: r["n"] for r in df.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(counts.values())
    return {k: whole / (2.0 * n) for k, n in counts.items()}


def with_class_weight(df: DataFrame, y: Column, out: str = "weight") -> DataFrame:
    """The balanced weight as a column, in one lazy plan."""
    totals = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))).scalar()
    n, pos = F.col("__w.n"), F.col("__w.pos")
    size = F.when(y == 1, pos).otherwise(n - pos)
    return df.withColumn("__w", totals).withColumn(out, n / (size * 2.0)).drop("__w")


@dataclass
class FittedClassifier:
    columns: list[str]
    fills: dict[str, float | None]
    scaling: dict[str, tuple[float, float]]
    model: object
    forest: IsolationForestModel | None = None

    def values(self, df: DataFrame) -> list[Column]:
        """Imputed, scaled feature expressions over ``df``."""
        return _values(df, self.columns, self.fills, self.scaling)

    def probability(self, df: DataFrame, out: str) -> DataFrame:
        """Add the probability of the positive class."""
        data = self.forest.score(df, ANOMALY_COLUMN) if self.forest else df
        data = _assembled(data, self.values(data))
        kept = [F.col(f"`{c}`") for c in df.columns]
        return self.model.transform(data).select(*kept, vector_to_array("probability")[1].alias(out))


def _values(df, columns, fills, scaling) -> list[Column]:
    out = []
    for c in columns:
        v = F.coalesce(finite(number(df, c)), F.lit(float(fills.get(c) or 0.0)))
        if c in scaling:
            v = (v - F.lit(scaling[c][0])) / F.lit(scaling[c][1])
        out.append(v)
    return out


def _assembled(df: DataFrame, values: list[Column]) -> DataFrame:
    names = [f"__x{i}" for i in range(len(values))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(
        df.withColumns(dict(zip(names, values)))).drop(*names)


def nullable_columns(df: DataFrame, columns) -> list[str]:
    """Columns that may hold NULL or infinity; flags and counts never do."""
    never = (T.BooleanType, T.IntegerType)
    return [c for c in columns if not isinstance(df.schema[c].dataType, never)]


def fitting_sample(train: DataFrame, spec: MeasurementSpec, config: ClassifierConfig, seed: int) -> DataFrame:
    """The rows a fit sees: all, or about ``config.max_rows`` of them by a digest of the row key."""
    if config.max_rows is None:
        return train
    rows = train.count()
    if rows <= config.max_rows:
        return train
    digest = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spec.row_key], F.lit(seed)), F.lit(2 ** 52)) / float(2 ** 52)
    return train.filter(digest < config.max_rows / rows)


def logistic_gradient(fitted: FittedClassifier, train: DataFrame, spec: MeasurementSpec, config: ClassifierConfig,
                      seed: int = 42, drawn: DataFrame | None = None) -> DataFrame:
    """(feature, coefficient, gradient): the penalised loss's slope at the fitted weights, per unit of row weight.

    One aggregation over the fitted rows. The loss is convex, so slopes of zero prove that no other weights fit better.
    The intercept is not penalised. ``drawn`` are the fitted rows, where they are known.
    """
    rows = fitting_sample(train, spec, config, seed) if drawn is None else drawn
    y = encode_label(spec)
    weights = class_weights(rows, y) if config.balanced else {0: 1.0, 1: 1.0}
    weight = F.when(y == 1, F.lit(weights.get(1, 1.0))).otherwise(F.lit(weights.get(0, 1.0)))
    names, slopes = ["(intercept)", *fitted.columns], [float(fitted.model.intercept), *map(float, fitted.model.coefficients)]
    data = rows.select(F.array(F.lit(1.0), *fitted.values(rows)).alias("x"), y.cast("double").alias("y"), weight.alias("w"))
    margin = F.aggregate(F.zip_with("x", F.array(*[F.lit(s) for s in slopes]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    error = data.select("x", "w", (F.col("w") * (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col("y"))).alias("e"))
    sums = error.agg(F.sum("w").alias("w"), *[F.sum(F.col("e") * F.col("x")[j]).alias(f"g{j}") for j in range(len(names))])
    penalty = [0.0, *slopes[1:]]
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(s).alias("coefficient"), (
        (F.col(f"g{j}") + F.lit(q)) / F.col("w")).alias("gradient")) for j, (n, s, q) in enumerate(zip(names, slopes, penalty))])
    return sums.select(F.inline(entries))


def fit_classifier(train: DataFrame, spec: MeasurementSpec, columns, config: ClassifierConfig,
                   seed: int = 42, fills: dict | None = None, drawn: DataFrame | None = None) -> FittedClassifier:
    """Median imputation, scaling for the logistic model, class weights, then the estimator.

    The fit sees all labelled rows. Their label and features are stored once, as the fit reads them many times, and deleted at its
    end; ``drawn`` are the rows, where the caller holds them for several fits. With ``config.max_rows`` it uses at most about that
    many rows, those first by a digest of the row key.
    """
    columns = list(columns)
    leaked = [c for c in columns if c in spec.never_features]
    if leaked:
        raise ValueError(f"id or target columns cannot be features: {leaked}")
    if drawn is None and config.max_rows is None:
        with scratch(train.sparkSession):
            held = train if (config.anomaly_feature and not present_keys(train, spec)) else _read_by_fits(train, spec, columns)
            return fit_classifier(train, spec, columns, config, seed, fills, stored(held, "training"))
    if drawn is None and (rows := fitting_sample(train, spec, config, seed)) is not train:
        rows = rows.persist()
        try:
            return fit_classifier(train, spec, columns, config, seed, fills, rows)
        finally:
            rows.unpersist()
    train = train if drawn is None else drawn
    forest = None
    if config.anomaly_feature:
        forest = fit_isolation_forest(train, columns, trees=100, seed=seed, keys=present_keys(train, spec))
        train, columns = forest.score(train, ANOMALY_COLUMN), [*columns, ANOMALY_COLUMN]
    needed = nullable_columns(train, columns)
    known = fills or {}
    unknown = [c for c in needed if c not in known]
    fills = {**{c: known[c] for c in needed if c in known}, **(fit_medians(train, unknown) if unknown else {})}
    y = encode_label(spec)
    weights = class_weights(train, y) if config.balanced else {0: 1.0, 1: 1.0}
    weight = F.when(y == 1, F.lit(weights.get(1, 1.0))).otherwise(F.lit(weights.get(0, 1.0)))
    scaling = {}
    if config.kind == "logistic":
        filled = train.select(*[v.alias(c) for c, v in zip(columns, _values(train, columns, fills, {}))])
        scaling = fit_scaling(filled, columns)
    data = _assembled(train, _values(train, columns, fills, scaling)).select(
        "features", y.cast("double").alias("label"), weight.alias("weight"))
    if config.max_rows is None:  # the estimators hold what they read again in a form of their own
        model = fit_logistic(train, y, columns, fills, scaling, weights, config.iterations) if config.kind == "logistic" else None
        model = model or _estimator(config, data, seed).fit(data)
    else:  # few rows and many short jobs
        data = data.repartition(max(1, config.max_rows // 20_000)).persist()
        model = _estimator(config, data, seed).fit(data)
        data.unpersist()
    return FittedClassifier(columns, fills, scaling, model, forest)


def _read_by_fits(train: DataFrame, spec: MeasurementSpec, columns) -> DataFrame:
    """What fits on ``columns`` read of the training rows: row key, label and features."""
    return train.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*present_keys(train, spec), spec.label_col, *columns])])


def _estimator(config: ClassifierConfig, data: DataFrame, seed: int):
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight"}
    if config.kind == "logistic":
        # Unit inverse regularisation strength, spread over the total weight.
        total = data.agg(F.sum("weight")).first()[0]
        return LogisticRegression(maxIter=config.iterations, regParam=1.0 / total, standardization=False,
                                  tol=1e-6, **common)
    if config.kind == "forest":
        return RandomForestClassifier(
            numTrees=config.trees, maxDepth=config.depth, minInstancesPerNode=config.min_instances,
            featureSubsetStrategy="sqrt", maxBins=128, maxMemoryInMB=1024, seed=seed, **common)
    if config.kind == "boosting":
        return GBTClassifier(maxIter=config.iterations, maxDepth=config.depth, stepSize=0.1, maxBins=255,
                             maxMemoryInMB=1024, seed=seed, **common)
    raise ValueError(f"unknown classifier kind {config.kind!r}")


def screening_features(df: DataFrame, spec: MeasurementSpec,
                       normal: NormalBehaviourModel | None = None) -> tuple[DataFrame, NormalBehaviourModel]:
    """Quality flags, row features and residual features; the normal model is fitted when none is given."""
    if normal is None:
        normal = fit_normal_behaviour(df, spec)
    return normal.transform(row_features(quality_flags(df, spec), spec)), normal


def full_columns(df: DataFrame, features: DataFrame, spec: MeasurementSpec) -> list[str]:
    """The measurements and everything ``screening_features`` has added to ``df``."""
    added = [c for c in features.columns if c not in df.columns and c not in spec.never_features]
    return [*spec.present(df), *added]


def set_columns(name: str, df: DataFrame, features: DataFrame, spec: MeasurementSpec) -> list[str]:
    raw = spec.present(df)
    if name == "Set_A_Raw":
        return raw
    if name == "Set_B_Raw_Quality":
        return [*raw, *SCORED_FLAGS]
    if name == "Set_C_Raw_Residuals":
        return [*raw, *[c for c in RESIDUAL_FEATURES if c in features.columns]]
    full = [c for c in full_columns(df, features, spec) if c != ANOMALY_COLUMN]
    if name == "Set_D_Full_Stage5":
        return full
    if name == "Set_E_Stage5_AnomalyScore":
        return [*full, ANOMALY_COLUMN]
    raise ValueError(f"unknown feature set {name!r}")


def contextual_sets(flagged: DataFrame, spec: MeasurementSpec) -> tuple[DataFrame, dict[str, list[str]]]:
    """The frame with contextual features and named column lists without constant columns.

    Anomaly sets A to D: raw; with context; with flags; all. Final sets A to C:
    raw and flags; raw and context; all.
    """
    df, _, context = with_context(flagged, spec)
    raw = spec.present(df)
    quality = [c for c in REPORTED_FLAGS if c in df.columns]
    kept = set(active_features(df, [*raw, *context, *quality]))
    chosen = {
        "raw": raw, "raw_context": [*raw, *context], "raw_quality": [*raw, *quality],
        "raw_context_quality": [*raw, *context, *quality], "raw_quality_context": [*raw, *quality, *context],
    }
    active = {k: [c for c in v if c in kept] for k, v in chosen.items()}
    return df, {
        "Anomaly_A": active["raw"], "Anomaly_B": active["raw_context"], "Anomaly_C": active["raw_quality"],
        "Anomaly_D": active["raw_context_quality"], "Final_A": active["raw_quality"],
        "Final_B": active["raw_context"], "Final_C": active["raw_quality_context"],
    }


def stratified_folds(df: DataFrame, spec: MeasurementSpec, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Fold 1..k per row, class shares kept to the row; the same under any partitioning."""
    ranked = rank_by_digest(df, [spec.label_col], spec.row_key, seed, "__rank")
    return ranked.withColumn(out, (F.pmod(F.col("__rank") - 1, F.lit(k)) + 1).cast("int")).drop("__rank")


def cross_validate(df: DataFrame, spec: MeasurementSpec, configs, feature_sets, k: int = 5, seed: int = 42,
                   forest_trees: int = 200, keep_features: bool = False, parallel: int = 4) -> DataFrame:
    """Out-of-fold probabilities of every model and feature set, fitted inside each fold only.

    Flags, normal models, medians, anomaly forests and classifiers see the training
    part alone; duplicate flags are those within each part. What the parts of all folds need of the rows, key counts and sums of
    products, is taken once per fold and subtracted from the total. One row per record, model and feature set.
    ``parallel`` fits of a fold run at a time, and each fold's result is stored before the next begins.
    """
    configs, feature_sets = list(configs), list(feature_sets)
    folds = durable(stratified_folds(df, spec, k, seed))
    split, normals = quality_flags_by_fold(folds, spec, k), fit_normal_by_fold(folds, spec, k)
    rows = folds.drop("fold")
    results = []
    cases = [(name, config) for name in feature_sets for config in configs]
    for i in range(1, k + 1):
        train, val = (normals[i - 1].transform(row_features(part, spec)) for part in split(i))
        if "Set_E_Stage5_AnomalyScore" in feature_sets:
            train, val = with_fold_anomaly(train, val, spec.present(df), ANOMALY_COLUMN, forest_trees, seed=seed, keys=spec.row_key)
        columns = {s: set_columns(s, rows, train, spec) for s in feature_sets}
        every = list(dict.fromkeys(c for cs in columns.values() for c in cs))
        kept = val.columns if keep_features else list(dict.fromkeys([*spec.row_key, spec.id_col, spec.label_col]))
        with scratch(df.sparkSession):
            train = stored(_read_by_fits(train, spec, every), "training")
            fills = fit_medians(train, nullable_columns(train, every))
            drawn = {n: fitting_sample(train, spec, c, seed) for n, c in {c.max_rows: c for c in configs}.items()}

            def fitted(case):
                name, config = case
                return fit_classifier(train, spec, columns[name], config, seed, fills, drawn[config.max_rows])

            models = in_parallel(df.sparkSession, fitted, cases, parallel)
        if len(cases) > 1:  # what all cases read is derived once
            val = stored(val.select(*dict.fromkeys([*kept, *every])), "held_out")
        scored = [model.probability(val, "oof_probability_invalid").select(
            *[F.col(f"`{c}`") for c in kept], F.lit(i).alias("fold"), F.lit(config.name).alias("model_name"),
            F.lit(name).alias("feature_set_name"), encode_label(spec).alias("true_invalid"), "oof_probability_invalid")
            for (name, config), model in zip(cases, models)]
        results.append(durable(reduce(DataFrame.unionByName, scored)))
    return reduce(DataFrame.unionByName, results)


def in_parallel(spark: SparkSession, work, cases, parallel: int) -> list:
    """``work`` of every case, in order; independent Spark jobs of a few at a time keep the cluster busy."""
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), cases))


def cross_validate_matrix(df: DataFrame, spec: MeasurementSpec, columns, config: ClassifierConfig,
                          k: int = 5, seed: int = 42, parallel: int = 4) -> DataFrame:
    """Out-of-fold probabilities on a ready feature matrix: only imputer and model are per fold."""
    folds = durable(stratified_folds(df, spec, k, seed))
    return matrix_oof(folds, spec, [("matrix", list(columns), config)], k, seed, parallel, keep=folds.columns).drop(
        "model_name", "feature_set_name")


def matrix_oof(folds: DataFrame, spec: MeasurementSpec, cases, k: int, seed: int, parallel: int, keep) -> DataFrame:
    """Out-of-fold probabilities of (set name, columns, config) cases on a table with folds.

    The medians of all columns and training parts are searched together; the fits of all cases and folds run a few at a time. The
    fits read the rows from ``folds``, which should be stored.
    """
    needed = nullable_columns(folds, dict.fromkeys(c for _, columns, _ in cases for c in columns))
    medians = quantiles_outside_folds(folds, {c: finite(number(folds, c)) for c in needed}, 0.5, "fold", k)

    trains = {i: folds.filter(F.col("fold") != i) for i in range(1, k + 1)}
    drawn = {(n, i): fitting_sample(train, spec, c, seed)
             for n, c in {c.max_rows: c for *_, c in cases}.items() for i, train in trains.items()}

    def scored(case):
        (name, columns, config), i = case
        fills = {c: medians[i - 1][c] for c in needed if c in columns}
        model = fit_classifier(trains[i], spec, columns, config, seed, fills, drawn[config.max_rows, i])
        return stored(model.probability(folds.filter(F.col("fold") == i), "oof_probability_invalid").select(
            *[F.col(f"`{c}`") for c in keep], "oof_probability_invalid", encode_label(spec).alias("true_invalid"),
            F.lit(config.name).alias("model_name"), F.lit(name).alias("feature_set_name")), "oof")

    pairs = [(case, i) for case in cases for i in range(1, k + 1)]
    return reduce(DataFrame.unionByName, in_parallel(folds.sparkSession, scored, pairs, parallel))


def out_of_fold(df: DataFrame, spec: MeasurementSpec, config: ClassifierConfig,
                feature_set: str = "Set_D_Full_Stage5", k: int = 5, seed: int = 42) -> DataFrame:
    """The validated out-of-fold table with all features, ranked in a stable order of the rows."""
    oof = cross_validate(df, spec, [config], [feature_set], k, seed, keep_features=True)
    check_oof(oof, spec)
    return rank_by_digest(oof, [], spec.row_key, None, "OOF_Rank")


def compare_models(oof: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of metrics per model and feature set, best F1 first."""
    p = F.col("oof_probability_invalid")
    long = oof.select("model_name", "feature_set_name", F.col("true_invalid").alias("y"),
                      (p >= threshold).cast("int").alias("pred"), p.alias("score"))
    table = evaluate_detectors(long, ["model_name", "feature_set_name"], macro=True)
    folds = oof.groupBy("model_name", "feature_set_name", "fold").agg(*[
        c.alias(n) for n, c in M.counts(F.col("true_invalid"), (p >= threshold).cast("int")).items()])
    spread = folds.withColumn("f1", M.f1()).groupBy("model_name", "feature_set_name").agg(
        F.stddev_pop("f1").alias("Invalid_F1_Std"))
    return table.join(F.broadcast(spread), ["model_name", "feature_set_name"]).orderBy(
        F.desc("Invalid_F1"), F.desc("Invalid_Recall"), F.desc("Invalid_Precision"), F.desc("Accuracy"),
        "model_name", "feature_set_name")


def evaluate_grid(df: DataFrame, spec: MeasurementSpec, grid: str = "screening", k: int = 5, seed: int = 42,
                  configs: dict[str, ClassifierConfig] | None = None, parallel: int = 4) -> DataFrame:
    """The sorted comparison of a whole grid of models and feature sets under cross-validation.

    ``screening``: three models on five fold-isolated feature sets. ``baseline``: three models on raw features and on
    raw features with flags, and the two rules. ``final``: four models on the three contextual sets. ``rules``: the two rules
    alone. ``configs`` may replace configurations by name.
    """
    known = CLASSIFIERS | (configs or {})
    if grid == "screening":
        names = GRIDS[grid][0]
        return compare_models(cross_validate(df, spec, [known[n] for n in names], GRIDS[grid][1], k, seed, parallel=parallel))
    if grid not in GRIDS:
        raise ValueError(f"unknown grid {grid!r}")
    frame, sets = contextual_sets(quality_flags(df, spec), spec)
    cases = [(name, sets[name], known[model]) for name in GRIDS[grid][1] for model in GRIDS[grid][0]]
    used = dict.fromkeys([*spec.row_key, spec.label_col, *RULE_COLUMNS, *[c for _, columns, _ in cases for c in columns]])
    folds = durable(stratified_folds(frame.select(*[F.col(f"`{c}`") for c in used]), spec, k, seed))
    keep = [*spec.row_key, "fold"]
    parts = [matrix_oof(folds, spec, cases, k, seed, parallel, keep)] if cases else []
    if grid in ("baseline", "rules"):
        for rule in ("definite_issue", "definite_plus_duplicate"):
            hit = rule_detector(folds, rule)
            parts.append(hit.select(*keep, F.col("rule_score").cast("double").alias("oof_probability_invalid"), encode_label(spec).alias("true_invalid"),
                                    F.lit(f"rule_{rule}").alias("model_name"), F.lit("flags").alias("feature_set_name")))
    return compare_models(reduce(DataFrame.unionByName, parts))


COMPARED = ("model_name", "feature_set_name", "Invalid_F1", "Invalid_Recall", "Invalid_Precision", "Accuracy")


def comparison_key(df: DataFrame, spec: MeasurementSpec, grid: str, settings: dict) -> dict[str, str]:
    """What a saved comparison depends on: digests of the rows, of the columns and of the settings."""
    columns = sorted(df.columns)
    rows = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    found = df.agg(F.count(F.lit(1)), F.bit_xor(rows), F.sum(F.shiftright(rows, 16))).first()
    parts = {"data": str(tuple(found)), "columns": str([(c, df.schema[c].dataType.simpleString()) for c in columns]),
             "settings": str((grid, spec, sorted((k, str(v)) for k, v in settings.items())))}
    return {k: hashlib.sha256(v.encode()).hexdigest() for k, v in parts.items()}


def resolve_best(df: DataFrame, spec: MeasurementSpec, folder: str, grid: str = "screening", **settings) -> tuple[DataFrame, str]:
    """The best configuration of a grid, from ``folder`` if a comparison was saved there for the same data, columns and settings.

    Returns it and how it came about: ``hit`` (saved before), ``miss`` (the folder knows no run of this grid) or ``stale`` (it
    has one, but of other data, columns or settings). A new run is saved under its key and entered in the manifest last, so
    an interrupted run is never taken for a result.
    """
    spark = df.sparkSession
    key = comparison_key(df, spec, grid, settings)
    manifest = "grid string, data string, columns string, settings string, path string"
    try:
        entries = spark.read.schema(manifest).json(f"{folder}/manifest").filter(F.col("grid") == grid).collect()
    except AnalysisException:  # no manifest yet
        entries = []
    same = [e for e in entries if all(e[k] == v for k, v in key.items())]
    if same:
        saved = spark.read.parquet(same[0]["path"])
        missing = set(COMPARED) - set(saved.columns)
        if missing:
            raise ValueError(f"the saved comparison lacks columns: {sorted(missing)}")
        return best_configuration(saved), "hit"
    path = f"{folder}/{grid}-{uuid.uuid4().hex}"
    with scratch(spark):
        evaluate_grid(df, spec, grid, **settings).write.parquet(path)
    spark.createDataFrame([(grid, key["data"], key["columns"], key["settings"], path)], manifest).coalesce(1).write.mode(
        "append").json(f"{folder}/manifest")
    return best_configuration(spark.read.parquet(path)), "stale" if entries else "miss"


def best_configuration(comparison: DataFrame) -> DataFrame:
    """The first row by F1, recall, precision, accuracy (all descending)."""
    return comparison.orderBy(
        F.desc("Invalid_F1"), F.desc("Invalid_Recall"), F.desc("Invalid_Precision"), F.desc("Accuracy"),
        "model_name", "feature_set_name").limit(1)


def oof_anomaly_flags(folds: DataFrame, spec: MeasurementSpec, trees: int = 200, seed: int = 42,
                      level: float = 0.95) -> DataFrame:
    """Per fold, a forest of the other folds flags what reaches their 95th percentile score."""
    columns = spec.present(folds)
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    parts = []
    for i in numbers:
        train, val = folds.filter(F.col("fold") != i), folds.filter(F.col("fold") == i)
        forest = fit_isolation_forest(train, columns, trees=trees, seed=seed, missing="zero", keys=present_keys(train, spec))
        cut = collect_quantiles(forest.score(train, "anomaly_score"), {"s": F.col("anomaly_score")}, [level])["s"][level]
        parts.append(forest.score(val, "anomaly_score").withColumn("anomaly_flag", F.col("anomaly_score") >= cut))
    return reduce(DataFrame.unionByName, parts)


def permutation_importance(fitted: FittedClassifier, df: DataFrame, spec: MeasurementSpec, repeats: int = 10,
                           threshold: float = 0.5, seed: int = 42, block_rows: int = 8192) -> DataFrame:
    """F1 lost when one feature is shuffled, mean and population deviation over the repeats; see ``importance``."""
    data = fitted.forest.score(df, ANOMALY_COLUMN) if fitted.forest else df
    return permuted_f1(fitted.model, data, [F.col(f"`{k}`") for k in spec.row_key], encode_label(spec), fitted.values(data),
                       fitted.columns, repeats, threshold, seed, block_rows)


@dataclass
class FinalValidityClassifier:
    """Flags and contextual features, constants removed, one classifier, one threshold."""

    spec: MeasurementSpec
    config: ClassifierConfig = CLASSIFIERS["random_forest"]
    feature_set: str = "Final_C"
    threshold: float = 0.5
    seed: int = 42
    columns: list[str] = field(default_factory=list)
    fitted: FittedClassifier | None = None

    def _features(self, df: DataFrame) -> DataFrame:
        return with_context(quality_flags(df, self.spec), self.spec)[0]

    def fit(self, df: DataFrame) -> "FinalValidityClassifier":
        if self.spec.label_col not in df.columns:
            raise ValueError(f"training data lacks {self.spec.label_col}")
        frame, sets = contextual_sets(quality_flags(df, self.spec), self.spec)
        self.columns = sets[self.feature_set]
        self.fitted = fit_classifier(frame, self.spec, self.columns, self.config, self.seed)
        return self

    def predict_proba(self, df: DataFrame, out: str = "Probability_Invalid") -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit must be called first")
        return self.fitted.probability(self._features(df), out)

    def predict(self, df: DataFrame, as_text: bool = True) -> DataFrame:
        scored = self.predict_proba(df)
        flag = (F.col("Probability_Invalid") >= self.threshold).cast("int")
        return scored.withColumn("Predicted_Validity", decode_label(flag, self.spec) if as_text else flag)

    def predict_dataset(self, df: DataFrame) -> DataFrame:
        keys = list(dict.fromkeys([*self.spec.row_key, self.spec.id_col]))
        return self.predict(df).select(
            *keys, F.round("Probability_Invalid", 4).alias("Probability_Invalid"), "Predicted_Validity")


@dataclass
class FinalHybridDetector:
    """A record is invalid when the classifier says so or a hard-corruption flag is raised."""

    spec: MeasurementSpec
    config: ClassifierConfig = CLASSIFIERS["Random_Forest"]
    feature_set: str = "Set_D_Full_Stage5"
    threshold: float = LOCKED_THRESHOLD
    seed: int = 42
    forest_trees: int = 200
    normal: NormalBehaviourModel | None = None
    fitted: FittedClassifier | None = None
    forest: IsolationForestModel | None = None

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must be between 0 and 1")

    def fit(self, df: DataFrame) -> "FinalHybridDetector":
        for needed in (self.spec.label_col, *self.spec.row_key):
            if needed not in df.columns:
                raise ValueError(f"training data lacks {needed}")
        self.forest = fit_isolation_forest(
            df, self.spec.present(df), trees=self.forest_trees, seed=self.seed, missing="zero", keys=self.spec.row_key)
        features, self.normal = screening_features(df, self.spec)
        if self.feature_set == "Set_E_Stage5_AnomalyScore":
            features = self.forest.score(features, ANOMALY_COLUMN)
        columns = set_columns(self.feature_set, df, features, self.spec)
        self.fitted = fit_classifier(features, self.spec, columns, self.config, self.seed)
        return self

    def _scored(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit must be called first")
        features, _ = screening_features(df, self.spec, self.normal)
        if self.feature_set == "Set_E_Stage5_AnomalyScore":
            features = self.forest.score(features, ANOMALY_COLUMN)
        missing = [c for c in self.fitted.columns if c not in features.columns]
        if missing:
            raise ValueError(f"feature columns are missing: {missing}")
        scored = self.fitted.probability(features, "Invalid_Probability")
        return scored.withColumns({
            "Model_Invalid": F.col("Invalid_Probability") >= self.threshold,
            "Hard_Quality_Evidence": hard_mask(features)})

    def _keys(self) -> list[str]:
        return list(dict.fromkeys([*self.spec.row_key, self.spec.id_col]))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self._scored(df).select(*self._keys(), "Invalid_Probability")

    def predict(self, df: DataFrame) -> DataFrame:
        invalid = (F.col("Model_Invalid") | F.col("Hard_Quality_Evidence")).cast("int")
        return self._scored(df).select(*self._keys(), decode_label(invalid, self.spec).alias(self.spec.label_col))

    def diagnose(self, df: DataFrame) -> DataFrame:
        """Label, probability, anomaly score, the reason, and the evidence columns per record."""
        scored = self.forest.score(self._scored(df), "Anomaly_Score")
        hard, model = F.col("Hard_Quality_Evidence"), F.col("Model_Invalid")
        reason = (F.when(hard, "deterministic_corruption").when(model, "supervised_probability")
                  .otherwise("model_valid"))
        return scored.select(
            *self._keys(), "Invalid_Probability", "Anomaly_Score", "Model_Invalid", "Hard_Quality_Evidence",
            decode_label((hard | model).cast("int"), self.spec).alias("Final_Validity_Label"),
            reason.alias("Reason_Evidence"), *HARD_FLAGS, *SOFT_EVIDENCE)


def lighter(config: ClassifierConfig, **changes) -> ClassifierConfig:
    return replace(config, **changes)
