"""Checks of anomaly detectors, classifiers, validation and the final detectors.

Isolation forests and LOF have SQL. The classifiers draw random numbers of Spark's own; what is exact about them has SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.storage import durable, new_path
from gaugesieve.operators import evaluate, models, submit
from gaugesieve.operators.baselines import baseline_predictions as run_predictions
from gaugesieve.operators.baselines import run_baselines
from gaugesieve.operators.detectors import fit_detector
from gaugesieve.operators.features import matrix_columns
from gaugesieve.operators.flags import HARD_FLAGS, REPORTED_FLAGS, SCORED_FLAGS, decode_label, hard_mask, quality_flags
from gaugesieve.operators.persist import DetectorEstimator, DetectorModel
from gaugesieve.plans import checks_features as rows
from gaugesieve.plans.checks_audit import union_all
from gaugesieve.plans.checks_classes import RESIDUAL_CTES
from gaugesieve.plans.checks_evaluation import (
    BAD, FLAG_SUM, FOLDS, MAX_Z, MOMENTS, QUARTILES, RULES, counts_sql, iqr_sum, metrics_sql,
)
from gaugesieve.plans.checks_flags import HARD_SQL, flags_sql
from gaugesieve.plans.forest_sql import forest_ctes, score_ctes
from gaugesieve.plans.measurements import PROBABILITY, SPEC, fitting_rows, measurements, scoring_rows, sql_with, with_sql
from gaugesieve.plans.registry import Checks, tagged
from gaugesieve.sources.io import read_result

checks = Checks()
FEATURES = list(SPEC.features)
# The library's own settings; a fit sees all labelled rows.
FIT_ROWS = None
FOREST = models.lighter(models.CLASSIFIERS["Random_Forest"], max_rows=FIT_ROWS)
FINAL_FOREST = models.lighter(models.CLASSIFIERS["random_forest"], max_rows=FIT_ROWS)
BOOSTING = models.lighter(models.CLASSIFIERS["Hist_Gradient_Boosting"], max_rows=FIT_ROWS)
LOGISTIC = models.lighter(models.CLASSIFIERS["Logistic_Regression"], max_rows=FIT_ROWS)


def embeddings(spark, sf_dir, dims: int = 64):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


def _values_sql(fills: dict[str, str]) -> str:
    return "[" + ", ".join(f"coalesce({c}, {fill})" for c, fill in fills.items()) + "]"


MEDIANS = {c: f"(SELECT median({c}) FROM m WHERE Test_ID % 4 <> 0)" for c in FEATURES}
IFOREST_SQL = sql_with(
    ("a", f"SELECT rid AS k, {_values_sql(MEDIANS)} AS x, Test_ID % 4 = 0 AS scored FROM m", True),
    ("fitted", "SELECT k, x FROM a WHERE NOT scored"), ("asked", "SELECT k, x FROM a WHERE scored"),
    *forest_ctes("fitted", len(FEATURES)), *score_ctes("asked", "found", fitted="fitted"),
    query="SELECT k AS rid, score AS iforest_score, (score > 0.5)::INT AS iforest_pred FROM found")


@checks.check("q_iforest", IFOREST_SQL, ["iforest_score"])
def isolation_forest(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return fit_detector(fitting_rows(df), SPEC).detect(scoring_rows(df)).select("rid", "iforest_score", "iforest_pred")


ZEROS = ("a", f"SELECT rid AS k, {_values_sql(dict.fromkeys(FEATURES, '0e0'))} AS x FROM m", True)


@checks.check("q_iforest_zero_fill", sql_with(
    ZEROS, *forest_ctes("a", len(FEATURES)), *score_ctes("a", "found"),
    query="SELECT k AS rid, score AS anomaly_score FROM found"), ["anomaly_score"])
def isolation_forest_zero(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return fit_detector(df, SPEC, missing="zero").score(df).select("rid", "anomaly_score")


@checks.check("q_iforest_embeddings", with_sql(
    ("a", "SELECT vec_id AS k, [" + ", ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(64)) + "] AS x FROM embeddings", True),
    *forest_ctes("a", 64), *score_ctes("a", "found"),
    query="SELECT k AS vec_id, score AS iforest_score, (score > 0.5)::INT AS iforest_pred FROM found"), ["iforest_score"])
def isolation_forest_embeddings(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return fit_detector(df, SPEC, columns=[c for c in df.columns if c != "vec_id"], keys=["vec_id"]).detect(df).select(
        "vec_id", "iforest_score", "iforest_pred")


def lof_sql(k: int, dims: int = 64) -> str:
    """LOF of every vector of ``embeddings`` against all of them, by comparing all pairs."""
    stats = ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS m{i}, stddev_pop(embedding[{i + 1}]::DOUBLE) AS s{i}" for i in range(dims))
    scaled = ", ".join(f"(embedding[{i + 1}]::DOUBLE - m{i}) / s{i}" for i in range(dims))
    return f"""WITH st AS (SELECT {stats} FROM embeddings), x AS (SELECT vec_id, [{scaled}] AS v FROM embeddings, st),
pairs AS (SELECT a.vec_id AS p, b.vec_id AS o, list_distance(a.v, b.v) AS d FROM x a, x b),
fit AS (SELECT * FROM pairs WHERE p <> o QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, o) <= {k}),
kd AS (SELECT p, max(d) AS kd FROM fit GROUP BY p),
lrd AS (SELECT fit.p, 1 / (avg(greatest(d, kd.kd)) + 1e-10) AS lrd FROM fit JOIN kd ON kd.p = fit.o GROUP BY fit.p),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, o) <= {k}),
own AS (SELECT near.p, 1 / (avg(greatest(d, kd.kd)) + 1e-10) AS lrd FROM near JOIN kd ON kd.p = near.o GROUP BY near.p),
lof AS (SELECT near.p AS vec_id, avg(lrd.lrd) / max(own.lrd) AS f FROM near JOIN lrd ON lrd.p = near.o JOIN own ON own.p = near.p GROUP BY near.p)
SELECT vec_id, f AS lof_score, (f > 1.5)::INT AS lof_pred FROM lof"""


@checks.check("q_lof", lof_sql(20), ["lof_score"])
def lof(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    columns = [c for c in df.columns if c != "vec_id"]
    return fit_detector(df, SPEC, "lof", columns=columns).detect(df).select("vec_id", "lof_score", "lof_pred")


@checks.check("q_lof_cells", lof_sql(20), ["lof_score"])
def lof_cells(spark, sf_dir):
    """The same factors found through many small cells: neighbours across cells are not lost."""
    df = embeddings(spark, sf_dir)
    columns = [c for c in df.columns if c != "vec_id"]
    return fit_detector(df, SPEC, "lof", columns=columns, points_per_cell=50).detect(df).select("vec_id", "lof_score", "lof_pred")


@checks.check("q_lof_measurements")
def lof_measurements(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return fit_detector(fitting_rows(df), SPEC, "lof").detect(scoring_rows(df)).select("rid", "lof_score", "lof_pred")


def _fold_forest(i: int) -> list[tuple]:
    """CTEs up to ``o<i>``: the rows of fold i flagged by a forest of the other folds."""
    return [(f"t{i}", f"SELECT k, x FROM a WHERE fold <> {i}"), *forest_ctes(f"t{i}", len(FEATURES), tag=f"_{i}_"),
            *[(n, t) for n, t in score_ctes("a", f"all{i}", fitted=f"t{i}", tag=f"_{i}_")][:-1],
            (f"all{i}", score_ctes("a", f"all{i}", fitted=f"t{i}", tag=f"_{i}_")[-1][1], True),
            (f"o{i}", f"""SELECT k AS rid, fold, score AS anomaly_score, score >= (SELECT quantile_cont(score, 0.95) FROM all{i} JOIN a USING (k)
 WHERE fold <> {i}) AS anomaly_flag FROM all{i} JOIN a USING (k) WHERE fold = {i}""")]


@checks.check("q_oof_anomaly", sql_with(
    ("s", "SELECT * FROM m"), FOLDS, ("a", f"SELECT rid AS k, {_values_sql(dict.fromkeys(FEATURES, '0e0'))} AS x, fold FROM fo", True),
    *[c for i in range(1, 6) for c in _fold_forest(i)],
    query=union_all(f"SELECT * FROM o{i}" for i in range(1, 6))), ["anomaly_score"])
def oof_anomaly(spark, sf_dir):
    rows = measurements(spark, sf_dir).select("rid", SPEC.label_col, *FEATURES)
    folds = durable(models.stratified_folds(rows, SPEC))
    return models.oof_anomaly_flags(folds, SPEC).select("rid", "fold", "anomaly_score", "anomaly_flag")


def _fit_and_score(spark, sf_dir, config, feature_set):
    df = measurements(spark, sf_dir)
    train, test = fitting_rows(df), df.filter(f"{SPEC.id_col} % 4 = 0")
    features, normal = models.screening_features(train, SPEC)
    columns = models.set_columns(feature_set, train, features, SPEC)
    fitted = models.fit_classifier(features, SPEC, columns, config)
    scored = fitted.probability(models.screening_features(test, SPEC, normal)[0], "probability_invalid")
    return scored.select("rid", SPEC.label_col, "probability_invalid")


@checks.check("q_logreg")
def logistic(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, LOGISTIC, "Set_D_Full_Stage5")


TOLERANCE = 1e-3
GRADIENT_OF = ["(intercept)", *FEATURES, *SCORED_FLAGS]


@checks.check("q_logreg_certificate", "SELECT unnest([" + ", ".join(f"'{c}'" for c in GRADIENT_OF) + "]) AS feature, true AS optimal")
def logistic_certificate(spark, sf_dir):
    """Whether the penalised loss is flat at the fitted weights, in the direction of every weight."""
    train, _ = models.screening_features(fitting_rows(measurements(spark, sf_dir)), SPEC)
    columns = [*FEATURES, *SCORED_FLAGS]
    train = durable(train.select(SPEC.label_col, *columns))
    fitted = models.fit_classifier(train, SPEC, columns, LOGISTIC, drawn=train)
    slopes = models.logistic_gradient(fitted, train, SPEC, LOGISTIC)
    return slopes.select("feature", (F.abs("gradient") < TOLERANCE).alias("optimal"))


@checks.check("q_random_forest")
def random_forest(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, FOREST, "Set_D_Full_Stage5")


@checks.check("q_gbt")
def boosting(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, BOOSTING, "Set_C_Raw_Residuals")


@checks.check("q_forest_with_anomaly")
def forest_with_anomaly(spark, sf_dir):
    config = models.lighter(FOREST, name="random_forest_anomaly", anomaly_feature=True)
    return _fit_and_score(spark, sf_dir, config, "Set_B_Raw_Quality")


GAPS = [n for *_, n in rows.DIFFS]
ROW_NAMES = [*GAPS, *rows.AGG_NAMES, "max_minus_min_sensors", "pairwise_abs_diff_mean", "pairwise_abs_diff_max", *rows.INTERACTION_NAMES]


@checks.check("q_stage5_features", sql_with(
    rows.TRAIN, *rows.ridge_ctes("train"), ("t", "SELECT * FROM m WHERE Test_ID % 4 = 0"), ("f", flags_sql("t")),
    ("e", f"SELECT f.*, {rows.EXPECTED} FROM f{rows.RIDGE_JOIN}"), query=f"""
SELECT rid, {", ".join(FEATURES)}, {", ".join(REPORTED_FLAGS)}, data_quality_issue_count, {rows.DIFF_SQL}, {rows.AGG_SQL},
 {rows.DISAGREEMENT_SQL}, {rows.INTERACTION_SQL}, {rows.RESIDUAL_SQL} FROM e"""), [*FEATURES, *ROW_NAMES, *rows.RESIDUAL_NAMES])
def full_features(spark, sf_dir):
    df = measurements(spark, sf_dir)
    _, normal = models.screening_features(fitting_rows(df), SPEC)
    features, _ = models.screening_features(scoring_rows(df), SPEC, normal)
    return features.select("rid", *matrix_columns(features, SPEC))


@checks.check("q_oof")
def out_of_fold(spark, sf_dir):
    oof = models.out_of_fold(measurements(spark, sf_dir), SPEC, FOREST)
    return oof.select("rid", SPEC.label_col, "fold", "true_invalid", "model_name", "feature_set_name",
                      "OOF_Rank", "oof_probability_invalid")


@checks.check("q_oof_matrix")
def out_of_fold_matrix(spark, sf_dir):
    flagged = quality_flags(measurements(spark, sf_dir), SPEC)
    frame, sets = models.contextual_sets(flagged, SPEC)
    oof = models.cross_validate_matrix(frame, SPEC, sets["Final_C"], LOGISTIC)
    return oof.select("rid", "fold", "true_invalid", "oof_probability_invalid")


PARTS = {"raw": FEATURES, "context": list(rows.CONTEXT), "quality": list(REPORTED_FLAGS)}
SETS = {"Anomaly_A": ["raw"], "Anomaly_B": ["raw", "context"], "Anomaly_C": ["raw", "quality"],
        "Anomaly_D": ["raw", "context", "quality"], "Final_A": ["raw", "quality"], "Final_B": ["raw", "context"],
        "Final_C": ["raw", "quality", "context"]}


@checks.check("q_contextual_sets", sql_with(
    ("f", flags_sql()), ("x", f"SELECT *, {rows.CONTEXT_SQL} FROM f"),
    ("kept", union_all(f"SELECT '{c}' AS feature FROM x HAVING count(DISTINCT {c}) > 1" for part in PARTS.values() for c in part)),
    ("listed", union_all(f"SELECT '{name}' AS set_name, {i} AS i, '{c}' AS feature" for name, parts in SETS.items()
                         for i, c in enumerate(c for part in parts for c in PARTS[part]))), query="""
SELECT set_name, CAST(row_number() OVER (PARTITION BY set_name ORDER BY i) - 1 AS INTEGER) AS place, feature
FROM listed JOIN kept USING (feature)"""))
def contextual_sets(spark, sf_dir):
    """Which features each contextual set keeps once constants are removed."""
    _, sets = models.contextual_sets(quality_flags(measurements(spark, sf_dir), SPEC), SPEC)
    placed = [(name, i, c) for name, columns in sets.items() for i, c in enumerate(columns)]
    return spark.createDataFrame(placed, "set_name string, place int, feature string")


def _grid(spark, sf_dir, name):
    """The whole grid of models, feature sets and folds; each fit sees all training rows of its fold."""
    return models.evaluate_grid(measurements(spark, sf_dir), SPEC, name)


@checks.check("q_model_comparison")
def model_comparison(spark, sf_dir):
    """The three models on the smallest and the largest feature set under fold isolation, small enough for a quick look."""
    oof = models.cross_validate(
        measurements(spark, sf_dir), SPEC,
        [LOGISTIC, models.lighter(FOREST, trees=10, depth=6), models.lighter(BOOSTING, iterations=5)],
        [models.FEATURE_SETS[0], models.FEATURE_SETS[-1]], k=2, forest_trees=50)
    return models.compare_models(oof)


@checks.check("q_grid_screening")
def grid_screening(spark, sf_dir):
    """The whole screening grid: three models on the five fold-isolated feature sets."""
    return _grid(spark, sf_dir, "screening")


@checks.check("q_grid_baseline")
def grid_baseline(spark, sf_dir):
    """Three models on two feature sets, and the two rules."""
    return _grid(spark, sf_dir, "baseline")


@checks.check("q_grid_final")
def grid_final(spark, sf_dir):
    """Four models on the three contextual sets."""
    return _grid(spark, sf_dir, "final")


def _rules_sql(where: str, attempts: dict[int, str]) -> str:
    """The better of the two rules on some rows, as the saved comparison names it."""
    rules = union_all(f"SELECT 'rule_{rule}' AS model_name, {counts_sql('pred')} FROM (SELECT CASE WHEN {BAD} THEN 1 ELSE 0 END AS y, {e}::INT AS pred FROM f)"
                      for rule, e in RULES.values())
    best = f"""SELECT model_name, {metrics_sql()} FROM ({rules}) ORDER BY Invalid_F1 DESC, Invalid_Recall DESC, Invalid_Precision DESC, Accuracy DESC,
 model_name LIMIT 1"""
    listed = ", ".join(f"({i}, '{status}')" for i, status in attempts.items())
    return sql_with(("t", f"SELECT * FROM m WHERE {where}"), ("f", flags_sql("t")), ("best", best), query=f"""
SELECT CAST(attempt AS INTEGER) AS attempt, status, model_name, Invalid_F1 FROM best, (VALUES {listed}) AS v(attempt, status)""")


@checks.check("q_best_saved", union_all([
    f"SELECT * FROM ({_rules_sql('true', {1: 'miss', 2: 'hit', 4: 'hit'})})", f"SELECT * FROM ({_rules_sql('Test_ID % 4 <> 0', {3: 'stale'})})"]), ["Invalid_F1"])
def best_saved(spark, sf_dir):
    """The best of a grid, run once and then taken from its saved comparison as long as the data are the same."""
    df, folder = measurements(spark, sf_dir), new_path(spark, "comparisons")
    found = []
    for attempt, rows in enumerate((df, df, fitting_rows(df), df), 1):
        best, status = models.resolve_best(rows, SPEC, folder, "rules")
        found.append(best.select(F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), "model_name", "Invalid_F1"))
    return reduce(DataFrame.unionByName, found)


@checks.check("q_oof_thresholds")
def oof_thresholds(spark, sf_dir):
    oof = models.cross_validate(measurements(spark, sf_dir), SPEC, [FOREST], ["Set_B_Raw_Quality"])
    return evaluate.threshold_sweep(oof, "oof_probability_invalid", F.col("true_invalid"))


@checks.check("q_permutation_importance")
def permutation_importance(spark, sf_dir):
    """Every feature of the full screening set, shuffled ten times."""
    df = measurements(spark, sf_dir)
    features, _ = models.screening_features(df, SPEC)
    fitted = models.fit_classifier(features, SPEC, models.full_columns(df, features, SPEC), FOREST)
    return models.permutation_importance(fitted, features, SPEC)


@checks.check("q_final_validity")
def final_validity(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return models.FinalValidityClassifier(SPEC, FINAL_FOREST).fit(fitting_rows(df)).predict_dataset(scoring_rows(df))


def detector(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return models.FinalHybridDetector(SPEC, FOREST).fit(fitting_rows(df)), scoring_rows(df)


@checks.check("q_hybrid_predict")
def hybrid_predict(spark, sf_dir):
    fitted, test = detector(spark, sf_dir)
    return submit.build_submission(fitted, test, SPEC)


class HardRules:
    """A detector without chance: invalid is what has a hard-corruption flag."""

    def predict(self, df):
        flagged = quality_flags(df, SPEC)
        return flagged.select("rid", decode_label(hard_mask(flagged).cast("int"), SPEC).alias(SPEC.label_col))


@checks.check("q_submission_written", sql_with(("t", "SELECT * FROM m WHERE Test_ID % 4 = 0"), ("f", flags_sql("t")), query=f"""
SELECT rid, CASE WHEN {HARD_SQL} THEN 'Invalid' ELSE 'Valid' END AS Validity_Label FROM f"""))
def submission_written(spark, sf_dir):
    """A submission predicted, checked, written as CSV and read back."""
    path = new_path(spark, "submission")
    rows = submit.build_submission(HardRules(), scoring_rows(measurements(spark, sf_dir)), SPEC, path)
    return read_result(spark, path, rows.schema, "csv")


@checks.check("q_detectors_saved", sql_with(query="""
SELECT kind, (SELECT count(*) FROM m WHERE Test_ID % 4 = 0) AS records, 0::BIGINT AS differing FROM (VALUES ('hybrid'), ('validity')) AS v(kind)"""))
def detectors_saved(spark, sf_dir):
    """Both final detectors fitted as estimators, saved to the shared folder, loaded and scored again: rows that differ."""
    df = measurements(spark, sf_dir)
    train, test = durable(fitting_rows(df)), durable(scoring_rows(df))
    found = []
    for kind, config in (("hybrid", FOREST), ("validity", FINAL_FOREST)):
        fitted = DetectorEstimator(SPEC, kind, config=config).fit(train)
        path = new_path(spark, "detector")
        fitted.write().save(path)
        before, after = (model.transform(test) for model in (fitted, DetectorModel.load(path)))
        rows = before.select("rid", F.struct(*before.columns).alias("a")).join(
            after.select("rid", F.struct(*before.columns).alias("b")), "rid", "full")
        found.append(rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("records"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing")))
    return reduce(DataFrame.unionByName, found)


@checks.check("q_diagnostics")
def diagnostics(spark, sf_dir):
    fitted, test = detector(spark, sf_dir)
    return fitted.diagnose(test)


@checks.check("q_baselines")
def baselines(spark, sf_dir):
    """The six baseline detectors side by side: predictions, metrics, error examples and regimes."""
    return tagged(run_baselines(measurements(spark, sf_dir), SPEC))


# The baselines without chance or with a forest that SQL repeats; LOF has its own check.
EXACT = ("quality", "iqr", "zscore", "residual", "iforest")
MEDIANS_OF_ALL = {c: f"(SELECT median({c}) FROM m)" for c in FEATURES}


@checks.check("q_baseline_predictions", sql_with(
    ("f", flags_sql()), QUARTILES, MOMENTS, *RESIDUAL_CTES, ("a", f"SELECT rid AS k, {_values_sql(MEDIANS_OF_ALL)} AS x FROM m", True),
    *forest_ctes("a", len(FEATURES)), *score_ctes("a", "found"), query=f"""
SELECT rid, CAST({FLAG_SUM} AS DOUBLE) AS quality_score, (({FLAG_SUM}) > 0)::INT AS quality_pred, iqr_score, iqr_pred, zscore_score, zscore_pred,
 coalesce(p1_max_abs_residual, 0) AS residual_score, (coalesce(p1_max_abs_residual, 0) > 3 OR coalesce(p1_consistency_index, 1) < 0.1)::INT
 AS residual_pred, score AS iforest_score, (score > 0.5)::INT AS iforest_pred
FROM f JOIN (SELECT rid, CAST({iqr_sum()} AS DOUBLE) AS iqr_score, (({iqr_sum()}) > 0)::INT AS iqr_pred FROM m, q) USING (rid)
 JOIN (SELECT rid, {MAX_Z} AS zscore_score, ({MAX_Z} > 3)::INT AS zscore_pred FROM m, z) USING (rid)
 JOIN (SELECT rid, p1_max_abs_residual, p1_consistency_index FROM r) USING (rid) JOIN found ON k = rid"""),
    [f"{m}_score" for m in EXACT])
def baseline_predictions(spark, sf_dir):
    """Five of the six baseline detectors on every record, as the baseline runner applies them."""
    frame = run_predictions(measurements(spark, sf_dir), SPEC, methods=EXACT)
    return frame.select("rid", *[c for m in EXACT for c in (f"{m}_score", f"{m}_pred")])


@checks.check("q_oof_rows", sql_with(("s", "SELECT * FROM m"), FOLDS, query=f"""
SELECT rid, Validity_Label, fold, CASE WHEN {BAD} THEN 1 ELSE 0 END AS true_invalid, 'Random_Forest' AS model_name,
 'Set_D_Full_Stage5' AS feature_set_name, row_number() OVER (ORDER BY md5(rid)) AS OOF_Rank FROM fo"""))
def out_of_fold_rows(spark, sf_dir):
    """What is certain about the out-of-fold table: every record once, its fold, label and rank."""
    oof = models.out_of_fold(measurements(spark, sf_dir), SPEC, FOREST)
    return oof.select("rid", SPEC.label_col, "fold", "true_invalid", "model_name", "feature_set_name", "OOF_Rank")


@checks.check("q_diagnostics_rows", sql_with(
    rows.TRAIN, *rows.ridge_ctes("train"), ("t", "SELECT * FROM m WHERE Test_ID % 4 = 0"), ("f", flags_sql("t")),
    ("e", f"SELECT f.*, {rows.EXPECTED} FROM f{rows.RIDGE_JOIN}"), ("r", f"SELECT *, {rows.RESIDUAL_SQL} FROM e"),
    ("a", f"SELECT rid AS k, {_values_sql(dict.fromkeys(FEATURES, '0e0'))} AS x, Test_ID % 4 = 0 AS scored FROM m", True),
    ("fitted", "SELECT k, x FROM a WHERE NOT scored"), ("asked", "SELECT k, x FROM a WHERE scored"),
    *forest_ctes("fitted", len(FEATURES)), *score_ctes("asked", "found", fitted="fitted"), query=f"""
SELECT rid, Test_ID, score AS Anomaly_Score, ({HARD_SQL}) AS Hard_Quality_Evidence, {", ".join([*HARD_FLAGS, *models.SOFT_EVIDENCE])}
FROM r JOIN found ON k = rid"""), ["Anomaly_Score", *models.SOFT_EVIDENCE])
def diagnostics_rows(spark, sf_dir):
    """What the final detector's diagnosis knows without its classifier: anomaly score, hard flags and residual evidence."""
    df = measurements(spark, sf_dir)
    fitted = models.FinalHybridDetector(SPEC, models.lighter(FOREST, trees=2, depth=2)).fit(fitting_rows(df))
    return fitted.diagnose(scoring_rows(df)).select(
        "rid", SPEC.id_col, "Anomaly_Score", "Hard_Quality_Evidence", *HARD_FLAGS, *models.SOFT_EVIDENCE)


@checks.check("q_hybrid_on_oof")
def hybrid_on_oof(spark, sf_dir):
    """The hybrid comparison on flags and residuals fitted on this table and fold-isolated anomaly flags."""
    df = durable(models.stratified_folds(measurements(spark, sf_dir), SPEC))
    flagged = models.oof_anomaly_flags(df, SPEC).select("rid", "anomaly_flag")
    features, _ = models.screening_features(df.drop("fold"), SPEC)
    evidence = features.select("rid", SPEC.label_col, F.expr(PROBABILITY).alias("p"), *HARD_FLAGS, *models.SOFT_EVIDENCE)
    joined = durable(evidence.join(flagged, "rid").drop("rid"))
    return evaluate.compare_hybrids(joined, SPEC, "p", F.col("anomaly_flag"))
