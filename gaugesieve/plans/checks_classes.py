"""Checks of the class-conditional analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugesieve.operators import classstats, transforms
from gaugesieve.operators.features import row_features
from gaugesieve.plans.checks_audit import union_all
from gaugesieve.plans.checks_features import (
    CONTEXT, CONTEXT_SQL, EXPECTED, PERFORMANCE, RESIDUAL_NAMES, RESIDUAL_SQL, RIDGE_JOIN, ridge_ctes)
from gaugesieve.plans.checks_features import checks as feature_checks
from gaugesieve.plans.checks_flags import EVIDENCE, EVIDENCE_SQL, FEATURES, I, T_, V, flags_sql, with_evidence
from gaugesieve.plans.measurements import SPEC, measurements, sql_with
from gaugesieve.plans.registry import Checks, rounded_sql, tagged, tagged_sql
from gaugesieve.spec import MeasurementSpec

checks = Checks()
COMPARED = [*FEATURES, *CONTEXT]
X = ("x", f"SELECT *, {CONTEXT_SQL} FROM m")
FL = ("f", flags_sql())
FX = ("fx", f"SELECT *, {CONTEXT_SQL} FROM f")
BAD = "Validity_Label = 'Invalid'"
GOOD = "Validity_Label = 'Valid'"


@checks.check("q_class_balance", sql_with(query=f"""
SELECT count(*) AS TotalRecords, count(*) FILTER (WHERE {GOOD}) AS ValidCount, 100e0 * count(*) FILTER (WHERE {GOOD}) / count(*) AS ValidPct,
 count(*) FILTER (WHERE {BAD}) AS InvalidCount, 100e0 * count(*) FILTER (WHERE {BAD}) / count(*) AS InvalidPct,
 count(*) FILTER (WHERE {GOOD}) / nullif(count(*) FILTER (WHERE {BAD}), 0) AS ImbalanceRatio,
 count(DISTINCT Validity_Label) AS ClassesFound FROM m"""), ["ValidPct", "InvalidPct", "ImbalanceRatio"])
def class_balance(spark, sf_dir):
    return classstats.class_balance(measurements(spark, sf_dir), SPEC)


def _class_stats(c: str, source: str, positive: str = BAD, negative: str = GOOD) -> str:
    parts = [f"SELECT '{c}' AS Feature"]
    for name, cond in (("Valid", negative), ("Invalid", positive)):
        f = f"FILTER (WHERE {cond})"
        parts.append(f"""count({c}) {f} AS {name}_Count, 100e0 * (count(*) {f} - count({c}) {f}) / count(*) {f} AS {name}_Missing_Rate_Pct,
 avg({c}) {f} AS {name}_Mean, stddev_samp({c}) {f} AS {name}_Std, median({c}) {f} AS {name}_Median,
 quantile_cont({c}, 0.01) {f} AS {name}_P1, quantile_cont({c}, 0.25) {f} AS {name}_P25, quantile_cont({c}, 0.75) {f} AS {name}_P75,
 quantile_cont({c}, 0.99) {f} AS {name}_P99, quantile_cont({c}, 0.75) {f} - quantile_cont({c}, 0.25) {f} AS {name}_IQR""")
    return ", ".join(parts) + f" FROM {source}"


STAT_NAMES = [f"{k}_{s}" for k in ("Valid", "Invalid") for s in (
    "Missing_Rate_Pct", "Mean", "Std", "Median", "P1", "P25", "P75", "P99", "IQR")]


@checks.check("q_class_stats", sql_with(X, query=union_all(_class_stats(c, "x") for c in COMPARED)), STAT_NAMES)
def class_stats(spark, sf_dir):
    return classstats.class_statistics(measurements(spark, sf_dir), SPEC)


TOXIC = MeasurementSpec(id_col="doc_id", label_col="toxic_label", positive="toxic", negative="clean", row_key=("doc_id",))


def toxic_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").withColumn(
        "toxic_label", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))


@checks.check("q_document_class_stats", _class_stats(
    "n_chars", "documents JOIN labels USING (doc_id)", "toxic = 1", "toxic <> 1"), STAT_NAMES)
def document_class_stats(spark, sf_dir):
    return classstats.class_statistics(toxic_documents(spark, sf_dir), TOXIC, ["n_chars"])


def _effect(c: str, f: str = "d") -> str:
    v, i = f"FILTER (WHERE {GOOD})", f"FILTER (WHERE {BAD})"
    pooled = (f"sqrt(((count({c}) {v} - 1) * var_samp({c}) {v} + (count({c}) {i} - 1) * var_samp({c}) {i})"
              f" / (count({c}) {v} + count({c}) {i} - 2))")
    return f"CASE WHEN {pooled} > 0 THEN (avg({c}) {i} - avg({c}) {v}) / {pooled} ELSE 0 END"


Y = f"CASE WHEN {BAD} THEN 1e0 ELSE 0e0 END"


def with_p_values(query: str, names: dict[str, str], n: str) -> str:
    """``query`` with a p-value column for each correlation column, by the power series of the incomplete beta function.

    Where its argument is large the p-value is below 1e-26 and stands as 0.
    """
    def p(r: str) -> str:
        x, a = f"least({r} * {r}, 1e0)", f"(({n} - 2) / 2e0)"
        front = f"2 * exp(0.5 * ln({x}) + {a} * ln(1 - {x}) + lgamma({a} + 0.5) - lgamma({a}) - lgamma(0.5))"
        term = f"exp(lgamma({a} + 0.5 + k) - lgamma({a} + 0.5) - lgamma(1.5 + k) + lgamma(1.5) + k * ln({x}))"
        return (f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN {x} * {a} > 60 THEN 0e0 WHEN {x} <= 0 THEN 1e0"
                f" ELSE 1 - {front} * list_sum(list_transform(range(400), lambda k: {term})) END")
    return f"SELECT *, {', '.join(f'{p(r)} AS {out}' for r, out in names.items())} FROM ({query})"


def _rho(c: str, source: str) -> str:
    return f"""(SELECT corr(r, y) FROM (SELECT {Y} AS y, rank() OVER (ORDER BY {c})
 + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS r FROM {source} WHERE {c} IS NOT NULL))"""


def _association(c: str) -> str:
    return f"""SELECT '{c}' AS Feature, corr({c}, {Y}) AS PointBiserial_Corr, {_rho(c, 'x')} AS Spearman_Corr,
 {_effect(c)} AS Cohens_D_EffectSize,
 100e0 * (count(*) FILTER (WHERE {GOOD}) - count({c}) FILTER (WHERE {GOOD})) / count(*) FILTER (WHERE {GOOD}) AS Valid_Missing_Rate_Pct,
 100e0 * (count(*) FILTER (WHERE {BAD}) - count({c}) FILTER (WHERE {BAD})) / count(*) FILTER (WHERE {BAD}) AS Invalid_Missing_Rate_Pct FROM x"""


@checks.check("q_associations", sql_with(X, query=union_all(map(_association, COMPARED))),
              ["PointBiserial_Corr", "Spearman_Corr", "Cohens_D_EffectSize", "Valid_Missing_Rate_Pct", "Invalid_Missing_Rate_Pct"])
def associations(spark, sf_dir):
    table = classstats.label_associations(measurements(spark, sf_dir), SPEC)
    return table.drop("PointBiserial_PValue", "Spearman_PValue")


ASSOCIATION_P = {"PointBiserial_Corr": "PointBiserial_PValue", "Spearman_Corr": "Spearman_PValue"}
ASSOCIATIONS_SQL = with_p_values(union_all(
    f"SELECT *, (SELECT count({c}) FROM x) AS n FROM ({_association(c)})"
    for c in COMPARED), ASSOCIATION_P, "n")
ASSOCIATION_DOUBLES = ["PointBiserial_Corr", "Spearman_Corr", "Cohens_D_EffectSize", "Valid_Missing_Rate_Pct", "Invalid_Missing_Rate_Pct",
                       *ASSOCIATION_P.values()]


@checks.check("q_association_p_values", sql_with(X, query=f"SELECT Feature, {', '.join(ASSOCIATION_P.values())} FROM ({ASSOCIATIONS_SQL})"),
              list(ASSOCIATION_P.values()))
def association_p_values(spark, sf_dir):
    return classstats.label_associations(measurements(spark, sf_dir), SPEC).select(
        "Feature", "PointBiserial_PValue", "Spearman_PValue")


PATTERNS = {
    "Missing Sensor S4": "Sensor_S4 IS NULL", "Missing Any Feature": "missing_any", "Negative Sensor S2": "sensor_s2_negative",
    "Zero Sensor Reading": "sensor_zero_reading", "High Sensor Spread (>50)": "Sensor_Spread > 50",
    "High Load Current (>95A)": f"{I} > 95", "High Applied Voltage (>28kV)": f"{V} > 28", "Low Applied Voltage (<12kV)": f"{V} < 12",
    "High Ambient Temp (>45C)": f"{T_} > 45", "Long Test Duration (>90min)": "Test_Duration_min > 90",
    "High Apparent Power (>2000kVA)": "Apparent_Power_kVA > 2000", "Definite Quality Issue": "data_quality_issue",
    "Duplicate Measurement Pair": "duplicate_measurement_pair",
}


def _pattern(name: str, cond: str) -> str:
    base = f"(SELECT avg({Y}) FROM fx)"
    return f"""SELECT '{name}' AS Pattern_Name, count(*) AS Total_Records, count(*) FILTER (WHERE {GOOD}) AS Valid_Count,
 count(*) FILTER (WHERE {BAD}) AS Invalid_Count, 100e0 * avg({Y}) AS Invalid_Rate_Pct, 100e0 * (1 - avg({Y})) AS Valid_Rate_Pct,
 100e0 * {base} AS Baseline_Invalid_Rate_Pct, avg({Y}) / {base} AS Lift_vs_Baseline FROM fx WHERE {cond} HAVING count(*) > 0"""


@checks.check("q_pattern_lift", sql_with(FL, FX, query=union_all(_pattern(*p) for p in PATTERNS.items())),
              ["Invalid_Rate_Pct", "Valid_Rate_Pct", "Baseline_Invalid_Rate_Pct", "Lift_vs_Baseline"])
def pattern_lift(spark, sf_dir):
    return classstats.pattern_lift(measurements(spark, sf_dir), SPEC)


def _first(tag: str, name: str, cond: str, columns: str, limit: int, source: str = "fx") -> str:
    return f"SELECT * FROM (SELECT '{tag}' AS {name}, {columns} FROM {source} WHERE {cond} ORDER BY Test_ID, rid LIMIT {limit})"


UNUSUAL = f"Test_ID, rid, {V}, {I}, {T_}, Sensor_Spread, Validity_Label"


@checks.check("q_unusual_regimes", sql_with(FL, FX, query=union_all([
    _first("Unusual Heavy-Load (Valid)", "Regime_Category", f"{I} > 95 AND {GOOD}", UNUSUAL, 5),
    _first("High Voltage Regime (Valid)", "Regime_Category", f"{V} > 28 AND {GOOD}", UNUSUAL, 5),
    _first("Normal Operating Range (Invalid)", "Regime_Category", f"""{V} BETWEEN 15 AND 25 AND {I} BETWEEN 50 AND 80
 AND {T_} BETWEEN 20 AND 35 AND NOT missing_any AND {BAD}""", UNUSUAL, 5)])), [V, I, T_, "Sensor_Spread"])
def unusual_regimes(spark, sf_dir):
    return classstats.unusual_regimes(measurements(spark, sf_dir), SPEC)


@checks.check("q_shortlist", sql_with(X, ("e", union_all(
    f"SELECT '{c}' AS Feature, abs({_effect(c)}) AS Abs_Effect FROM x" for c in COMPARED)), query="""
SELECT Feature, CASE WHEN Abs_Effect > 0.5 OR Feature IN ('Sensor_S4', 'Sensor_Spread') THEN 'A' WHEN Abs_Effect > 0.2 THEN 'B' ELSE 'C' END
 AS Category, Abs_Effect FROM e""" + "".join(f"\nUNION ALL SELECT '{h}', 'C', NULL" for h in classstats.HYPOTHESES)), ["Abs_Effect"])
def shortlist(spark, sf_dir):
    return classstats.variable_shortlist(measurements(spark, sf_dir), SPEC)


EVALUATED = {**{c: c for c in FEATURES}, "S1_minus_S2": "Sensor_S1 - Sensor_S2", "Thermal_Loading_Index": f"{I} * Test_Duration_min"}


@checks.check("q_feature_evaluation", sql_with(
    ("x", "SELECT Validity_Label, " + ", ".join(f"{e} AS {n}" for n, e in EVALUATED.items()) + " FROM m"),
    query="SELECT * EXCLUDE (n) FROM (" + with_p_values(union_all(
        f"""SELECT '{c}' AS feature_name, avg({c}) FILTER (WHERE {GOOD}) AS valid_mean, avg({c}) FILTER (WHERE {BAD}) AS invalid_mean,
 corr({c}, {Y}) AS pearson_r, CASE WHEN abs(corr({c}, {Y})) > 0.3 THEN 'Strong' WHEN abs(corr({c}, {Y})) > 0.1 THEN 'Moderate' ELSE 'Weak' END
 AS separation, count({c}) AS n FROM x HAVING count({c}) > 10 AND count(DISTINCT {c}) > 1""" for c in EVALUATED), {"pearson_r": "p_value"}, "n") + ")"),
    ["valid_mean", "invalid_mean", "pearson_r", "p_value"])
def feature_evaluation(spark, sf_dir):
    df = row_features(measurements(spark, sf_dir), SPEC)
    return classstats.feature_evaluation(df, SPEC, list(EVALUATED))


SHOWN = f"Test_ID, rid, {V}, {I}, {T_}, Sensor_S1, Sensor_S2, Sensor_S3, Sensor_S4, Sensor_Spread, data_quality_issue AS DataQualityIssue, Validity_Label"


@checks.check("q_representatives", sql_with(FL, FX, query=union_all([
    _first("Unusual Valid", "CaseCategory", f"{I} > 95 AND {GOOD}", SHOWN, 1),
    _first("Quality Issue Invalid", "CaseCategory", f"data_quality_issue AND {BAD}", SHOWN, 1),
    _first("Missing S4 Invalid", "CaseCategory", f"Sensor_S4 IS NULL AND {BAD}", SHOWN, 1),
    _first("Sensor Disagreement Invalid", "CaseCategory", f"Sensor_Spread > 50 AND {BAD}", SHOWN, 1),
    _first("Normal-Looking Invalid", "CaseCategory", f"{V} BETWEEN 18 AND 22 AND {I} BETWEEN 50 AND 70 AND NOT missing_any AND {BAD}", SHOWN, 1)])),
    [V, I, T_, *SPEC.sensors, "Sensor_Spread"])
def representatives(spark, sf_dir):
    return classstats.representatives(measurements(spark, sf_dir), SPEC)


def _relationship(kind: str, a: str, b: str) -> str:
    label = ("CASE WHEN r > 0.7 THEN 'Strong Inter-Sensor Alignment' ELSE 'Moderate Alignment' END" if kind == "Cross_Sensor_Pair"
             else "CASE WHEN abs(r) > 0.6 THEN 'Strong Linear' WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END")
    return f"""SELECT '{kind}' AS Category, '{a}' AS Variable_1, '{b}' AS Variable_2, n AS Sample_Count, r AS Pearson_r, rho AS Spearman_rho,
 {label} AS Relationship_Type FROM (SELECT count(*) AS n, corr({a}, {b}) AS r, corr(ra, rb) AS rho FROM (SELECT {a}, {b},
 rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2e0 AS ra,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2e0 AS rb
 FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


CONDITIONS = [I, V, T_, "Test_Duration_min"]
RELATED = [("Operating_vs_Sensor", a, b) for a in CONDITIONS for b in SPEC.sensors] + [
    ("Cross_Sensor_Pair", a, b) for k, a in enumerate(SPEC.sensors) for b in SPEC.sensors[k + 1:]]


RELATIONSHIP_P = {"Pearson_r": "Pearson_p", "Spearman_rho": "Spearman_p"}


@checks.check("q_relationships", sql_with(query=with_p_values(union_all(_relationship(*r) for r in RELATED), RELATIONSHIP_P, "Sample_Count")),
              [*RELATIONSHIP_P, *RELATIONSHIP_P.values()])
def relationships(spark, sf_dir):
    return classstats.relationships(measurements(spark, sf_dir), SPEC)


def _residual(c: str) -> str:
    g, b = f"FILTER (WHERE {GOOD})", f"FILTER (WHERE {BAD})"
    return f"""SELECT '{c}' AS Residual_Feature, avg({c}) {g} AS Valid_Mean, median({c}) {g} AS Valid_Median, stddev_samp({c}) {g} AS Valid_Std,
 avg({c}) {b} AS Invalid_Mean, median({c}) {b} AS Invalid_Median, stddev_samp({c}) {b} AS Invalid_Std, {_effect(c)} AS Cohens_D_EffectSize,
 (SELECT 100e0 * avg(CASE WHEN {c} > (SELECT quantile_cont({c}, 0.9) FROM r WHERE {GOOD}) THEN 1 ELSE 0 END) FROM r WHERE {BAD}
  AND {c} IS NOT NULL) AS Invalid_Extreme_Residual_Rate_Pct FROM r"""


@checks.check("q_residual_stats", sql_with(("r", EVIDENCE_SQL), query=union_all(map(_residual, EVIDENCE))), [
    "Valid_Mean", "Valid_Median", "Valid_Std", "Invalid_Mean", "Invalid_Median", "Invalid_Std", "Cohens_D_EffectSize",
    "Invalid_Extreme_Residual_Rate_Pct"])
def residual_stats(spark, sf_dir):
    return classstats.residual_statistics(with_evidence(measurements(spark, sf_dir)), SPEC)


# Residuals of every row under the normal behaviour fitted on the Valid ones.
RESIDUAL_CTES = [*ridge_ctes("m"), ("e", f"SELECT m.*, {EXPECTED} FROM m{RIDGE_JOIN}"), ("r", f"SELECT *, {RESIDUAL_SQL} FROM e")]
RELIABILITY = f"""
SELECT Target_Sensor AS Sensor, R2_Score AS Normal_Model_R2, RMSE AS Normal_Model_RMSE, AbsResidual_EffectSize,
 CASE WHEN R2_Score > 0.5 AND abs(AbsResidual_EffectSize) > 0.5 THEN 'High' WHEN R2_Score > 0.2 THEN 'Moderate' ELSE 'Low' END
 AS Reliability_Rank FROM ({PERFORMANCE}) JOIN ({union_all(
    f"SELECT '{s}' AS Target_Sensor, {_effect(f'{s}_AbsResidual')} AS AbsResidual_EffectSize FROM r" for s in SPEC.sensors)})
 USING (Target_Sensor)"""
RELIABILITY_DOUBLES = ["Normal_Model_R2", "Normal_Model_RMSE", "AbsResidual_EffectSize"]


@checks.check("q_sensor_reliability", sql_with(*RESIDUAL_CTES, query=RELIABILITY), RELIABILITY_DOUBLES)
def sensor_reliability(spark, sf_dir):
    df = measurements(spark, sf_dir)
    model = transforms.fit_normal_behaviour(df, SPEC)
    stats = classstats.residual_statistics(
        model.transform(df), SPEC, [f"{s}_AbsResidual" for s in SPEC.sensors])
    return classstats.sensor_reliability(stats, model.performance(df))


@checks.check("q_unusual_residuals", sql_with(("r", EVIDENCE_SQL), query=union_all(
    _first(tag, "Category", cond, f"""Test_ID, rid, {I}, p1_max_abs_residual AS Max_Abs_Residual, p1_consistency_index AS Consistency_Index,
 Validity_Label""", 5, "r") for tag, cond in (
        ("Unusual Heavy Load (Valid)", f"{I} > 95 AND {GOOD}"),
        ("Normal Parameters (Invalid)", f"{V} BETWEEN 15 AND 25 AND {I} BETWEEN 50 AND 80 AND {BAD}")))),
    [I, "Max_Abs_Residual", "Consistency_Index"])
def unusual_residuals(spark, sf_dir):
    return classstats.unusual_residuals(with_evidence(measurements(spark, sf_dir)), SPEC)


@checks.check("q_sensor_investigation", sql_with(query=f"""
SELECT 'Sensor_S4 Missingness Signal' AS Analysis_Aspect, count(*) AS Records, 100e0 * avg({Y}) AS Value FROM m WHERE Sensor_S4 IS NULL
""" + "".join(f"""UNION ALL SELECT '{s} Correlation with Invalidity', NULL, corr(coalesce({s}, 0), {Y}) FROM m WHERE Sensor_S4 IS NOT NULL
""" for s in SPEC.sensors)), ["Value"])
def sensor_investigation(spark, sf_dir):
    return classstats.sensor_investigation(measurements(spark, sf_dir), SPEC)


@checks.check("q_history_run", tagged_sql({
    "class_balance": checks.sql["q_class_balance"], "class_statistics": checks.sql["q_class_stats"],
    "associations": rounded_sql(sql_with(X, query=f"SELECT * EXCLUDE (n) FROM ({ASSOCIATIONS_SQL})"), ASSOCIATION_DOUBLES), "patterns": checks.sql["q_pattern_lift"],
    "regimes": checks.sql["q_unusual_regimes"], "shortlist": checks.sql["q_shortlist"],
    "representatives": checks.sql["q_representatives"]}))
def history_run(spark, sf_dir):
    """The rows of all history analyses."""
    return tagged(classstats.run_history(measurements(spark, sf_dir), SPEC))


REPORTED = [*[n for n in RESIDUAL_NAMES if "Expected" not in n], "p1_regime_cluster"]
RESIDUAL_STATS = ["Valid_Mean", "Valid_Median", "Valid_Std", "Invalid_Mean", "Invalid_Median", "Invalid_Std", "Cohens_D_EffectSize",
                  "Invalid_Extreme_Residual_Rate_Pct"]


@checks.check("q_behaviour_run", tagged_sql({
    "relationships": checks.sql["q_relationships"],
    "regimes": feature_checks.sql["q_regime_summary"].replace("FROM h ", "FROM m "), "performance": feature_checks.sql["q_normal_fit"],
    "residual_statistics": rounded_sql(sql_with(*RESIDUAL_CTES, query=union_all(map(_residual, REPORTED))), RESIDUAL_STATS),
    "reliability": checks.sql["q_sensor_reliability"],
    "representatives": checks.sql["q_unusual_residuals"].replace(f"r AS ({EVIDENCE_SQL})", ",\n".join(
        f"{name} AS ({text})" for name, text in RESIDUAL_CTES))}))
def behaviour_run(spark, sf_dir):
    """The rows of all behaviour reports; q_regimes and q_residuals return the row frames."""
    results = classstats.run_behaviour(measurements(spark, sf_dir), SPEC)
    reports = ("relationships", "regimes", "performance", "residual_statistics", "reliability", "representatives")
    return tagged({k: results[k] for k in reports})
