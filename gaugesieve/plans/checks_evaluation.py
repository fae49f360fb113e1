"""Checks of detectors, metrics, thresholds, error reports and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugesieve.operators import detectors, evaluate, flags, models, submit
from gaugesieve.operators.features import REGIME_NAMES
from gaugesieve.plans.checks_audit import union_all
from gaugesieve.plans.checks_classes import BAD, FL
from gaugesieve.plans.checks_features import REGIME_CODE
from gaugesieve.plans.checks_flags import EVIDENCE, FEATURES, I, T_, V, with_evidence
from gaugesieve.plans.measurements import PROBABILITY, SPEC, measurements, scored, scoring_rows, sql_with
from gaugesieve.plans.registry import Checks

checks = Checks()
S = ("s", f"SELECT *, {PROBABILITY} AS p, CASE WHEN {BAD} THEN 1 ELSE 0 END AS y FROM m")
METRICS = ["Invalid_Precision", "Invalid_Recall", "Invalid_F1", "Balanced_Accuracy", "Accuracy"]


def y():
    return flags.encode_label(SPEC)


def metrics_sql(extra: str = "") -> str:
    """Metric columns over a table with TP, TN, FP, FN."""
    return f"""coalesce(TP / nullif(TP + FP, 0), 0) AS Invalid_Precision, coalesce(TP / nullif(TP + FN, 0), 0) AS Invalid_Recall,
 coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0) AS Invalid_F1, (TP / (TP + FN) + TN / (TN + FP)) / 2 AS Balanced_Accuracy,
 (TP + TN) / (TP + TN + FP + FN) AS Accuracy{extra}"""


def counts_sql(pred: str) -> str:
    return f"""count(*) FILTER (WHERE y = 1 AND {pred} = 1) AS TP, count(*) FILTER (WHERE y = 0 AND {pred} = 0) AS TN,
 count(*) FILTER (WHERE y = 0 AND {pred} = 1) AS FP, count(*) FILTER (WHERE y = 1 AND {pred} = 0) AS FN"""


MACRO = ", (2 * TP / (2 * TP + FP + FN) + 2 * TN / (2 * TN + FP + FN)) / 2 AS Macro_F1"


# Detectors ---------------------------------------------------------------------------------

@checks.check("q_rule_detector", sql_with(FL, query="""
SELECT rid, data_quality_issue::INT AS definite_pred, data_quality_issue::INT::DOUBLE AS definite_score,
 (data_quality_issue OR duplicate_measurement_pair)::INT AS dup_pred FROM f"""), ["definite_score"])
def rule_detector(spark, sf_dir):
    df = flags.quality_flags(measurements(spark, sf_dir), SPEC)
    out = detectors.rule_detector(df, "definite_issue", "definite")
    return detectors.rule_detector(out, "definite_plus_duplicate", "dup").select(
        "rid", "definite_pred", "definite_score", "dup_pred")


FLAG_SUM = " + ".join(f"{f}::INT" for f in flags.SCORED_FLAGS)


@checks.check("q_det_quality", sql_with(FL, query=f"""
SELECT rid, CAST({FLAG_SUM} AS DOUBLE) AS quality_score, (({FLAG_SUM}) > 0)::INT AS quality_pred FROM f"""), ["quality_score"])
def det_quality(spark, sf_dir):
    df = flags.quality_flags(measurements(spark, sf_dir), SPEC)
    return detectors.quality_detector(df).select("rid", "quality_score", "quality_pred")


def iqr_sum(q: str = "q", reach: str = "1.5") -> str:
    return " + ".join(f"""CASE WHEN q3_{c} - q1_{c} > 0 AND ({c} < q1_{c} - {reach} * (q3_{c} - q1_{c})
 OR {c} > q3_{c} + {reach} * (q3_{c} - q1_{c})) THEN 1 ELSE 0 END""" for c in FEATURES)


QUARTILES = ("q", "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in FEATURES) + " FROM m")


@checks.check("q_iqr", sql_with(QUARTILES, query=f"""
SELECT rid, CAST({iqr_sum()} AS DOUBLE) AS iqr_score, (({iqr_sum()}) > 0)::INT AS iqr_pred FROM m, q"""), ["iqr_score"])
def iqr(spark, sf_dir):
    return detectors.iqr_detector(measurements(spark, sf_dir), SPEC).select("rid", "iqr_score", "iqr_pred")


MOMENTS = ("z", "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END AS s_{c}" for c in FEATURES) + " FROM m")
MAX_Z = "coalesce(greatest(" + ", ".join(f"abs(({c} - m_{c}) / s_{c})" for c in FEATURES) + "), 0)"


@checks.check("q_zscore", sql_with(MOMENTS, query=f"SELECT rid, {MAX_Z} AS zscore_score, ({MAX_Z} > 3)::INT AS zscore_pred FROM m, z"),
              ["zscore_score"])
def zscore(spark, sf_dir):
    return detectors.zscore_detector(measurements(spark, sf_dir), SPEC).select("rid", "zscore_score", "zscore_pred")


OTHERS = [c for c in FEATURES if c != V]
OTHER_Z = "coalesce(greatest(" + ", ".join(f"abs(({c} - m_{c}) / s_{c})" for c in OTHERS) + "), 0)"


@checks.check("q_zscore_inf", sql_with(("z", "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END AS s_{c}" for c in OTHERS) + " FROM m"),
    query=f"SELECT rid, {OTHER_Z} AS zscore_score, ({OTHER_Z} > 3)::INT AS zscore_pred FROM m, z", variant="inf"), ["zscore_score"])
def zscore_inf(spark, sf_dir):
    """A column with infinities decides nothing."""
    return detectors.zscore_detector(measurements(spark, sf_dir, "inf"), SPEC).select("rid", "zscore_score", "zscore_pred")


E_SQL = ", ".join(f"{e} AS {n}" for n, e in EVIDENCE.items())
R = ("r", f"SELECT *, {E_SQL} FROM m")


@checks.check("q_residual_detector", sql_with(R, query="""
SELECT rid, coalesce(p1_max_abs_residual, 0) AS residual_score,
 (coalesce(p1_max_abs_residual, 0) > 3 OR coalesce(p1_consistency_index, 1) < 0.1)::INT AS residual_pred FROM r"""), ["residual_score"])
def residual_detector(spark, sf_dir):
    return detectors.residual_detector(with_evidence(measurements(spark, sf_dir))).select(
        "rid", "residual_score", "residual_pred")


# Metrics -----------------------------------------------------------------------------------

# Two methods with exactly known scores: the pseudo-probability and the z-score detector.
BOTH = ("l", f"""SELECT 'hash' AS method, y, (p >= 4e-1)::INT AS pred, p AS score FROM s
UNION ALL SELECT 'zscore', CASE WHEN {BAD} THEN 1 ELSE 0 END, ({MAX_Z} > 3)::INT, round({MAX_Z}, 9) FROM m, z""")
COUNTS = ("c", f"SELECT method, {counts_sql('pred')} FROM l GROUP BY method")
AUC = ("auc", """SELECT method, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) AS ROC_AUC
FROM (SELECT method, y, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2e0 AS r
 FROM l) GROUP BY method""")
AP = ("ap", """SELECT method, sum(pos * tp / n) / max(tp) AS PR_AUC FROM (SELECT method, pos, sum(pos) OVER w AS tp, sum(k) OVER w AS n
 FROM (SELECT method, score, sum(y) AS pos, count(*) AS k FROM l GROUP BY method, score)
 WINDOW w AS (PARTITION BY method ORDER BY score DESC)) GROUP BY method""")


def both_methods(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"hash_pred": (F.col("p") >= 0.4).cast("int"), "hash_score": F.col("p")})
    df = detectors.zscore_detector(df, SPEC).withColumn("zscore_score", F.round("zscore_score", 9))
    return evaluate.long_predictions(df, ["hash", "zscore"], y(), ["rid"])


@checks.check("q_confusion", sql_with(S, MOMENTS, BOTH, COUNTS, query="SELECT * FROM c"))
def confusion(spark, sf_dir):
    return evaluate.confusion(both_methods(spark, sf_dir), ["method"])


@checks.check("q_confusion_matrix", sql_with(S, query="""
SELECT 'True Valid' AS Actual, count(*) FILTER (WHERE p < 4e-1) AS Predicted_Valid, count(*) FILTER (WHERE p >= 4e-1) AS Predicted_Invalid,
 count(*) AS Row_Total FROM s WHERE y = 0 UNION ALL
SELECT 'True Invalid', count(*) FILTER (WHERE p < 4e-1), count(*) FILTER (WHERE p >= 4e-1), count(*) FROM s WHERE y = 1"""))
def confusion_matrix(spark, sf_dir):
    df = scored(spark, sf_dir)
    return evaluate.confusion_matrix(df.select(y().alias("y"), (F.col("p") >= 0.4).cast("int").alias("pred")))


@checks.check("q_detector_metrics", sql_with(S, MOMENTS, BOTH, COUNTS, AUC, AP, query=f"""
SELECT method, TP, TN, FP, FN, TP + FP AS Num_Flagged, 100e0 * (TP + FP) / (TP + TN + FP + FN) AS Flag_Pct,
 {metrics_sql(MACRO)}, ROC_AUC, PR_AUC FROM c JOIN auc USING (method) JOIN ap USING (method)"""),
    ["Flag_Pct", *METRICS, "Macro_F1", "ROC_AUC", "PR_AUC"])
def detector_metrics(spark, sf_dir):
    return evaluate.evaluate_detectors(both_methods(spark, sf_dir), macro=True)


@checks.check("q_roc_auc", sql_with(S, MOMENTS, BOTH, AUC, query="SELECT * FROM auc"), ["ROC_AUC"])
def roc_auc(spark, sf_dir):
    return evaluate.ranking_metrics(both_methods(spark, sf_dir), ["method"]).drop("PR_AUC")


@checks.check("q_avg_precision", sql_with(S, MOMENTS, BOTH, AP, query="SELECT * FROM ap"), ["PR_AUC"])
def avg_precision(spark, sf_dir):
    return evaluate.ranking_metrics(both_methods(spark, sf_dir), ["method"]).drop("ROC_AUC")


@checks.check("q_event_auc", """SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) AS ROC_AUC
FROM (SELECT y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2e0 AS r
 FROM (SELECT value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events))""", ["ROC_AUC"])
def event_auc(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate.ranking_metrics(events.select(
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"), F.col("value").alias("score"))).drop("PR_AUC")


CURVE = ("g", """SELECT score, sum(pos) OVER w AS tp, sum(k) OVER w AS n, (SELECT sum(y) FROM l WHERE method = 'zscore') AS pt,
 (SELECT count(*) FROM l WHERE method = 'zscore') AS t FROM (SELECT score, sum(y) AS pos, count(*) AS k FROM l WHERE method = 'zscore' GROUP BY score)
 WINDOW w AS (ORDER BY score DESC)""")


def zscore_only(spark, sf_dir):
    return both_methods(spark, sf_dir).filter("method = 'zscore'")


@checks.check("q_roc_curve", sql_with(S, MOMENTS, BOTH, CURVE, query="""
SELECT score AS threshold, (n - tp) / (t - pt) AS fpr, tp / pt AS tpr FROM g"""), ["threshold", "fpr", "tpr"])
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(zscore_only(spark, sf_dir))


@checks.check("q_pr_curve", sql_with(S, MOMENTS, BOTH, CURVE, query="""
SELECT score AS threshold, tp / n AS precision, tp / pt AS recall FROM g"""), ["threshold", "precision", "recall"])
def pr_curve(spark, sf_dir):
    return evaluate.precision_recall_curve(zscore_only(spark, sf_dir))


RULES = {"Rule-based (Definite Quality Issue)": ("definite_issue", "data_quality_issue"),
         "Rule-based (Definite Issue + Duplicate Pair)": (
             "definite_plus_duplicate", "(data_quality_issue OR duplicate_measurement_pair)")}


@checks.check("q_rule_evaluation", sql_with(FL, ("c", union_all(
    f"SELECT '{n}' AS Model, {counts_sql('pred')} FROM (SELECT CASE WHEN {BAD} THEN 1 ELSE 0 END AS y, {e}::INT AS pred FROM f)"
    for n, (_, e) in RULES.items())), query=f"SELECT Model, TP, TN, FP, FN, {metrics_sql(MACRO)} FROM c"), [*METRICS, "Macro_F1"])
def rule_evaluation(spark, sf_dir):
    df = flags.quality_flags(measurements(spark, sf_dir), SPEC)
    first, second = (evaluate.evaluate_rule(df, SPEC, rule) for rule, _ in RULES.values())
    return first.unionByName(second)


# Thresholds --------------------------------------------------------------------------------

SWEEP = ("w", union_all(f"SELECT {t!r}::DOUBLE AS Threshold, {counts_sql(f'(p >= {t!r}::DOUBLE)::INT')} FROM s" for t in evaluate.THRESHOLDS))
SWEPT = ("sw", f"""SELECT *, TP + FP AS Num_Flagged, 100e0 * (TP + FP) / (TP + TN + FP + FN) AS Flag_Pct, {metrics_sql()},
 '[[' || TN || ', ' || FP || '], [' || FN || ', ' || TP || ']]' AS Confusion_Matrix FROM w""")


@checks.check("q_threshold_sweep", sql_with(S, SWEEP, SWEPT, query="SELECT * FROM sw"), ["Threshold", "Flag_Pct", *METRICS])
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(scored(spark, sf_dir), "p", y())


NEAR = ("near", "SELECT *, (SELECT max(Invalid_F1) FROM sw) AS best FROM sw WHERE Invalid_F1 >= (SELECT max(Invalid_F1) FROM sw) - 0.02")
CHOICE = "Invalid_Recall DESC, Invalid_Precision DESC, FP, Threshold"


@checks.check("q_threshold_select", sql_with(S, SWEEP, SWEPT, NEAR, query=f"""
SELECT Threshold AS selected_threshold, best AS best_f1, (SELECT count(*) FROM near) AS candidate_count,
 (SELECT string_agg(printf('%.2f', Threshold), ', ' ORDER BY {CHOICE}) FROM near) AS candidate_thresholds,
 Invalid_F1, Invalid_Recall, Invalid_Precision FROM near ORDER BY {CHOICE} LIMIT 1"""),
    ["selected_threshold", "best_f1", "Invalid_F1", "Invalid_Recall", "Invalid_Precision"])
def threshold_select(spark, sf_dir):
    sweep = evaluate.threshold_sweep(scored(spark, sf_dir), "p", y())
    return evaluate.select_threshold(sweep, tolerance=0.02)


@checks.check("q_threshold_best", sql_with(S, SWEEP, SWEPT, query="""
SELECT * FROM sw ORDER BY Invalid_F1 DESC, Threshold LIMIT 1"""), ["Threshold", "Flag_Pct", *METRICS])
def threshold_best(spark, sf_dir):
    return evaluate.best_threshold(evaluate.threshold_sweep(scored(spark, sf_dir), "p", y()))


FOLDS = ("fo", """SELECT *, CAST((row_number() OVER (PARTITION BY Validity_Label ORDER BY md5(rid || '-42')) - 1) % 5 + 1 AS INT) AS fold FROM s""")
PER_FOLD = ("pf", f"SELECT fold AS Fold, {counts_sql('(p >= 4e-1)::INT')} FROM fo GROUP BY fold")


@checks.check("q_folds", sql_with(S, FOLDS, query="SELECT rid, fold FROM fo"))
def folds(spark, sf_dir):
    return models.stratified_folds(scored(spark, sf_dir), SPEC).select("rid", "fold")


def fold_table(spark, sf_dir):
    return evaluate.fold_metrics(models.stratified_folds(scored(spark, sf_dir), SPEC), "p", y(), 0.4)


@checks.check("q_fold_metrics", sql_with(S, FOLDS, PER_FOLD, query=f"""
SELECT *, TP + TN + FP + FN AS Fold_Size, {metrics_sql()} FROM pf"""), METRICS)
def fold_metrics(spark, sf_dir):
    return fold_table(spark, sf_dir)


@checks.check("q_fold_stability", sql_with(S, FOLDS, PER_FOLD, ("pm", f"SELECT {metrics_sql()} FROM pf"), query=union_all(
    f"SELECT '{n}' AS Metric, avg({n}) AS Mean, stddev_pop({n}) AS Std, min({n}) AS Min, max({n}) AS Max FROM pm" for n in METRICS)),
    ["Mean", "Std", "Min", "Max"])
def fold_stability(spark, sf_dir):
    return evaluate.fold_stability(fold_table(spark, sf_dir))


@checks.check("q_class_weights", sql_with(query=f"""
SELECT Validity_Label, count(*) AS n, (SELECT count(*) FROM m) / (2e0 * count(*)) AS weight FROM m GROUP BY Validity_Label"""), ["weight"])
def class_weights(spark, sf_dir):
    weighted = models.with_class_weight(measurements(spark, sf_dir), y())
    return weighted.groupBy(SPEC.label_col).agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))


# Error reports -----------------------------------------------------------------------------

REGIME_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in REGIME_NAMES.items())
REGIME = f"CASE {REGIME_CODE} {REGIME_CASES} END"


@checks.check("q_regime_performance", sql_with(S, MOMENTS, ("lr", f"""SELECT {REGIME} AS g, y, 'hash' AS method, (p >= 4e-1)::INT AS pred FROM s
UNION ALL SELECT {REGIME}, CASE WHEN {BAD} THEN 1 ELSE 0 END, 'zscore', ({MAX_Z} > 3)::INT FROM m, z"""),
    ("c", f"SELECT g, method, {counts_sql('pred')} FROM lr GROUP BY g, method HAVING count(*) >= 5"), query="""
SELECT g AS Operating_Regime, TP + TN + FP + FN AS Regime_Record_Count, TP + FN AS Regime_Invalid_Count, method AS Method,
 coalesce(TP / nullif(TP + FP, 0), 0) AS Precision, coalesce(TP / nullif(TP + FN, 0), 0) AS Recall,
 coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0) AS F1_Score FROM c"""), ["Precision", "Recall", "F1_Score"])
def regime_performance(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"hash_pred": (F.col("p") >= 0.4).cast("int"), "hash_score": F.col("p")})
    return evaluate.regime_performance(detectors.zscore_detector(df, SPEC), SPEC, ["hash", "zscore"])


@checks.check("q_error_examples", sql_with(S, ("er", f"""
SELECT 'hash' AS Method, CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END AS Error_Type, Test_ID, rid, CASE WHEN y = 0 THEN {REGIME} END AS Operating_Regime,
 {I}, {V}, Validity_Label FROM s WHERE y <> (p >= 4e-1)::INT"""), query="""
SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY Method, Error_Type ORDER BY Test_ID, rid) <= 10"""), [I, V])
def error_examples(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"hash_pred": (F.col("p") >= 0.4).cast("int"), "hash_score": F.col("p")})
    return evaluate.error_examples(df, SPEC, ["hash"])


WRONG = ("wr", f"""SELECT rid, {E_SQL}, CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END AS error_type, (p >= 4e-1)::INT AS selected_prediction_binary,
 CASE WHEN p >= 4e-1 THEN 'Invalid' ELSE 'Valid' END AS selected_prediction, {REGIME} AS operating_regime,
 {I} > 85 AS high_current_flag, {V} > 25 AS high_voltage_flag, {T_} > 30 AS high_temperature_flag, Test_Duration_min >= 120 AS long_duration_flag
FROM s WHERE y <> (p >= 4e-1)::INT""")
WRONG2 = ("w2", """SELECT *, coalesce(p1_max_abs_residual >= 10, false) AS high_residual_flag,
 coalesce(p1_sensor_disagreement_index >= 1.5, false) AS sensor_disagreement_flag FROM wr""")
WRONG_COLUMNS = ["rid", "error_type", "selected_prediction_binary", "selected_prediction", "operating_regime", "high_current_flag",
                 "high_voltage_flag", "high_temperature_flag", "long_duration_flag", "high_residual_flag", "sensor_disagreement_flag"]


def errors(spark, sf_dir):
    return evaluate.misclassifications(with_evidence(scored(spark, sf_dir)), SPEC, "p", 0.4)


@checks.check("q_misclassified", sql_with(S, WRONG, WRONG2, query=f"SELECT {', '.join(WRONG_COLUMNS)} FROM w2"))
def misclassified(spark, sf_dir):
    return errors(spark, sf_dir).select(*WRONG_COLUMNS)


def _context_pattern(kind: str, name: str, cond: str) -> str:
    return f"""SELECT error_type AS Error_Type, '{kind}' AS Pattern_Category, '{name}' AS Pattern, count(*) FILTER (WHERE {cond}) AS Count,
 100e0 * count(*) FILTER (WHERE {cond}) / count(*) AS Rate_Pct FROM w2 GROUP BY error_type"""


@checks.check("q_error_patterns", sql_with(S, WRONG, WRONG2, query=union_all([
    """SELECT error_type AS Error_Type, 'Operating Regime' AS Pattern_Category, operating_regime AS Pattern, count(*) AS Count,
 100e0 * count(*) / sum(count(*)) OVER (PARTITION BY error_type) AS Rate_Pct FROM w2 GROUP BY error_type, operating_regime""",
    _context_pattern("Residual Severity", "p1_max_abs_residual >= 10", "high_residual_flag"),
    _context_pattern("Load", "Load_Current_A > 85", "high_current_flag"),
    _context_pattern("Voltage", "Applied_Voltage_kV > 25", "high_voltage_flag")])), ["Rate_Pct"])
def error_patterns(spark, sf_dir):
    return evaluate.error_patterns(errors(spark, sf_dir), SPEC)


KIND = f"CASE WHEN y < pred THEN '{evaluate.ERROR_TYPES[0]}' WHEN y > pred THEN '{evaluate.ERROR_TYPES[1]}' ELSE '{evaluate.ERROR_TYPES[2]}' END"


@checks.check("q_uncertain", sql_with(S, query=f"""
SELECT rid, {KIND} AS Error_Type FROM (SELECT *, (p >= 5e-1)::INT AS pred FROM s) WHERE y <> pred OR p BETWEEN 4e-1 AND 6e-1"""))
def uncertain(spark, sf_dir):
    df = scored(spark, sf_dir)
    return evaluate.uncertain_or_wrong(df, y(), (F.col("p") >= 0.5).cast("int"), F.col("p")).select("rid", "Error_Type")


@checks.check("q_error_extract", sql_with(S, FL, query=f"""
SELECT s.rid, CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END AS error_type, f.{V}, f.{I}, f.{T_}, f.missing_any, f.duplicate_measurement_pair,
 f.data_quality_issue FROM s JOIN f ON s.rid = f.rid WHERE y <> (p >= 4e-1)::INT"""), [V, I, T_])
def error_extract(spark, sf_dir):
    df = scored(spark, sf_dir)
    predictions = df.select("rid", y().alias("y"), (F.col("p") >= 0.4).cast("int").alias("pred"))
    context = flags.quality_flags(measurements(spark, sf_dir), SPEC)
    return evaluate.error_extract(predictions, context, SPEC, [
        V, I, T_, "missing_any", "duplicate_measurement_pair", "data_quality_issue"]).drop("y", "pred")


AGREE = ("ag", f"""SELECT s.rid, p, y, (p >= 4e-1)::INT AS supervised_flag, ({MAX_Z} > 2)::INT AS anomaly_flag, {MAX_Z} AS anomaly_score
FROM s, z""")
GROUP = "CASE " + " ".join(f"WHEN supervised_flag = {s} AND anomaly_flag = {a} THEN '{n}'"
                           for (s, a), n in evaluate.AGREEMENT_GROUPS.items()) + " END"


def verdicts(spark, sf_dir):
    df = detectors.zscore_detector(scored(spark, sf_dir), SPEC, threshold=2.0)
    return df.withColumns({"supervised_flag": (F.col("p") >= 0.4).cast("int"), "anomaly_flag": F.col("zscore_pred")})


@checks.check("q_agreement", sql_with(S, MOMENTS, AGREE, query=f"""
SELECT {GROUP} AS Agreement_Group, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER () AS pct FROM ag GROUP BY 1"""), ["pct"])
def agreement(spark, sf_dir):
    return evaluate.agreement(verdicts(spark, sf_dir), F.col("supervised_flag"), F.col("anomaly_flag"))


@checks.check("q_supervised_anomaly", sql_with(S, MOMENTS, AGREE, query=f"""
SELECT rid, p, supervised_flag, anomaly_score, anomaly_flag, {GROUP} AS Agreement_Group FROM ag"""), ["p", "anomaly_score"])
def supervised_anomaly(spark, sf_dir):
    df = verdicts(spark, sf_dir)
    return evaluate.supervised_anomaly_table(
        df.select("rid", "p", "supervised_flag"),
        df.select("rid", F.col("zscore_score").alias("anomaly_score"), "anomaly_flag"), SPEC)


@checks.check("q_disagreement_cases", sql_with(S, MOMENTS, AGREE, FL, query=f"""
SELECT ag.rid, {GROUP} AS Agreement_Group, {", ".join(f"f.{c}" for c in FEATURES)}, f.missing_any, f.data_quality_issue
FROM ag JOIN f ON ag.rid = f.rid WHERE supervised_flag <> anomaly_flag"""), FEATURES)
def disagreement_cases(spark, sf_dir):
    df = verdicts(spark, sf_dir)
    table = evaluate.supervised_anomaly_table(df.select("rid", "supervised_flag"), df.select("rid", "anomaly_flag"), SPEC)
    context = flags.quality_flags(measurements(spark, sf_dir), SPEC)
    return evaluate.disagreement_cases(table, context, SPEC, [*FEATURES, "missing_any", "data_quality_issue"]).drop(
        "supervised_flag", "anomaly_flag")


HARD = " OR ".join(f"f.{f}" for f in flags.HARD_FLAGS)
MASKS = ("mk", f"""SELECT y, p AS score, p >= 4e-1 AS supervised, ({HARD}) AS quality, coalesce(r.p1_max_abs_residual >= 10, false)
 OR coalesce(r.p1_consistency_index <= 0.10, false) OR coalesce(r.p1_sensor_disagreement_index >= 1.5, false) AS consistency,
 f.Test_ID % 20 = 0 AS anomaly FROM s JOIN f ON s.rid = f.rid JOIN r ON s.rid = r.rid""")


def _hybrid(name: str, used) -> str:
    mask = " OR ".join(["supervised", *used])
    has = ", ".join([f"{bool(used)} AS Quality_Evidence",
                     *[f"{u in used} AS {u.capitalize()}_Evidence" for u in ("consistency", "anomaly")]])
    return f"SELECT '{name}' AS Approach, {has}, {counts_sql(f'({mask})::INT')} FROM mk"


LONE = ("l", "SELECT 'p' AS method, y, score FROM mk")


@checks.check("q_hybrid_comparison", sql_with(S, FL, R, MASKS, LONE, AUC, AP, ("h", union_all(
    _hybrid(*h) for h in evaluate.HYBRIDS.items())), query=f"SELECT h.*, {metrics_sql()}, ROC_AUC, PR_AUC FROM h, auc, ap"),
    [*METRICS, "ROC_AUC", "PR_AUC"])
def hybrid_comparison(spark, sf_dir):
    df = with_evidence(flags.quality_flags(measurements(spark, sf_dir), SPEC)).withColumn("p", F.expr(PROBABILITY))
    return evaluate.compare_hybrids(df, SPEC, "p", F.col(SPEC.id_col) % 20 == 0)


@checks.check("q_hybrid_score", sql_with(S, ("a", "SELECT *, CAST(Test_ID % 97 AS DOUBLE) AS anomaly FROM s"), ("b2", """
SELECT y, p, 0.7::DOUBLE * p + 0.3::DOUBLE * (anomaly - (SELECT min(anomaly) FROM a)) / ((SELECT max(anomaly) - min(anomaly) FROM a) + 1e-5) AS h FROM a"""),
    ("c", f"""SELECT 's' AS k, {counts_sql('(p >= 4e-1)::INT')} FROM b2 UNION ALL SELECT 'h', {counts_sql('(h >= 4e-1)::INT')} FROM b2"""),
    ("g", "SELECT k, 2 * TP / (2 * TP + FP + FN) AS f1 FROM c"), query="""
SELECT s.f1 AS supervised_f1, h.f1 AS hybrid_f1, h.f1 > s.f1 + 0.005 AS hybrid_retained FROM g s, g h WHERE s.k = 's' AND h.k = 'h'"""),
    ["supervised_f1", "hybrid_f1"])
def hybrid_score(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("anomaly", (F.col(SPEC.id_col) % 97).cast("double"))
    return evaluate.hybrid_score(df, "p", "anomaly", y(), 0.4)


@checks.check("q_oof_check", sql_with(S, query="""
SELECT count(*) AS rows, count(*) FILTER (WHERE p IS NULL) AS missing_probability, count(*) FILTER (WHERE p < 0 OR p > 1) AS out_of_range,
 CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM s GROUP BY Test_ID) WHERE n > 1) AS BIGINT) AS repeated_id_rows FROM s"""))
def oof_check(spark, sf_dir):
    return evaluate.oof_violations(scored(spark, sf_dir), [SPEC.id_col], "p")


@checks.check("q_best_config", sql_with(S, MOMENTS, BOTH, COUNTS, query=f"""
SELECT method AS model_name, 'given' AS feature_set_name, {metrics_sql()} FROM c
ORDER BY Invalid_F1 DESC, Invalid_Recall DESC, Invalid_Precision DESC, Accuracy DESC LIMIT 1"""), METRICS)
def best_config(spark, sf_dir):
    table = evaluate.evaluate_detectors(both_methods(spark, sf_dir), ranking=False).select(
        F.col("method").alias("model_name"), F.lit("given").alias("feature_set_name"), *METRICS)
    return models.best_configuration(table)


# Submissions -------------------------------------------------------------------------------

@checks.check("q_final_submission", sql_with(S, query="""
SELECT rid, 2e0 * Applied_Voltage_kV AS Predicted_Reference_Parameter, CASE WHEN p >= 4e-1 THEN 'Invalid' ELSE 'Valid' END AS Validity_Label
FROM s WHERE Test_ID % 4 = 0"""), ["Predicted_Reference_Parameter"])
def final_submission(spark, sf_dir):
    df = scored(spark, sf_dir).filter("Test_ID % 4 = 0")
    values = df.select("rid", (F.col(V) * 2.0).alias(SPEC.target_col))
    labels = df.select("rid", flags.decode_label((F.col("p") >= 0.4).cast("int"), SPEC).alias(SPEC.label_col))
    return submit.final_submission(scoring_rows(measurements(spark, sf_dir)), values, labels, SPEC)


@checks.check("q_id_set_check", sql_with(query="""
SELECT Test_ID, CASE WHEN a THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT Test_ID, bool_or(Test_ID % 4 <> 0) AS a,
 bool_or(Test_ID % 3 <> 0) AS b FROM m GROUP BY Test_ID) WHERE a <> b"""))
def id_set_check(spark, sf_dir):
    df = measurements(spark, sf_dir).select(SPEC.id_col)
    return submit.id_set_difference(df.filter("Test_ID % 4 <> 0"), df.filter("Test_ID % 3 <> 0"), SPEC.id_col)


@checks.check("q_submission_check", sql_with(query="""
SELECT count(*) - (SELECT count(*) FROM m WHERE Test_ID % 4 = 0) AS row_difference, 0::BIGINT AS missing_ids, 0::BIGINT AS repeated_ids,
 (SELECT count(*) FROM m WHERE (Test_ID % 4 = 0) <> (Test_ID % 2 = 0)) AS unmatched_ids,
 count(*) FILTER (WHERE Test_ID % 5 = 0) AS missing_labels, count(*) FILTER (WHERE Test_ID % 5 <> 0 AND Test_ID % 7 = 0) AS unknown_labels
FROM m WHERE Test_ID % 2 = 0"""))
def submission_check(spark, sf_dir):
    """A faulty submission: too many records, some labels missing or unknown."""
    df = measurements(spark, sf_dir)
    label = F.expr("CASE WHEN Test_ID % 5 = 0 THEN NULL WHEN Test_ID % 7 = 0 THEN 'Unknown' ELSE 'Valid' END")
    predictions = df.filter("Test_ID % 2 = 0").select("rid", label.alias(SPEC.label_col))
    return submit.submission_violations(predictions, scoring_rows(df), SPEC)
