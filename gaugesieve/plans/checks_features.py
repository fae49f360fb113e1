"""Checks of row features, regimes and fitted transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugesieve.functions.rowwise import number
from gaugesieve.operators import features, transforms
from gaugesieve.plans.checks_flags import EVIDENCE_SQL, FEATURES, S1, S2, S3, S4, D, I, V, with_evidence
from gaugesieve.plans.checks_audit import MEAN4, SPREAD, union_all
from gaugesieve.plans.measurements import SPEC, fitting_rows, measurements, scored, scoring_rows, sql_with
from gaugesieve.plans.measurements import PROBABILITY
from gaugesieve.plans.registry import Checks

checks = Checks()
DIFFS = [(a, b, f"{a[-2:]}_minus_{b[-2:]}") for i, a in enumerate(SPEC.sensors) for b in SPEC.sensors[i + 1:]]


DIFF_SQL = ", ".join(f"{a} - {b} AS {n}" for a, b, n in DIFFS)


@checks.check("q_sensor_diffs", sql_with(query=f"SELECT rid, {DIFF_SQL} FROM m"), [n for *_, n in DIFFS])
def sensor_diffs(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return df.select("rid", *[c.alias(n) for n, c in features.sensor_differences(df, SPEC).items()])


def _row_aggregates(sensors, tail):
    values = f"[{', '.join(sensors)}]"
    return (f"list_avg({values}) AS sensor_mean_{tail}, list_median({values}) AS sensor_median_{tail}, "
            f"list_stddev_samp({values}) AS sensor_std_{tail}")


AGG_SQL = f"{_row_aggregates(SPEC.sensors[:3], 'S1_S2_S3')}, {_row_aggregates(SPEC.sensors, 'S1_S2_S3_S4')}"
AGG_NAMES = [f"sensor_{s}_{t}" for t in ("S1_S2_S3", "S1_S2_S3_S4") for s in ("mean", "median", "std")]


@checks.check("q_sensor_aggs", sql_with(query=f"SELECT rid, {AGG_SQL} FROM m"), AGG_NAMES)
def sensor_aggs(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return df.select("rid", *[c.alias(n) for n, c in features.sensor_aggregates(df, SPEC).items()])


GAPS = ", ".join(f"abs({a} - {b})" for a, b, _ in DIFFS)


DISAGREEMENT_SQL = f"""{SPREAD} AS max_minus_min_sensors, list_avg([{GAPS}]) AS pairwise_abs_diff_mean,
 greatest({GAPS}) AS pairwise_abs_diff_max"""


@checks.check("q_disagreement", sql_with(
    query=f"SELECT rid, {DISAGREEMENT_SQL}, ({SPREAD}) / (abs({MEAN4}) + 1e-5) AS disagreement_index FROM m"),
    ["max_minus_min_sensors", "pairwise_abs_diff_mean", "pairwise_abs_diff_max", "disagreement_index"])
def disagreement(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return df.select("rid", *[c.alias(n) for n, c in features.sensor_disagreement(df, SPEC).items()],
                     features.disagreement_index(df, SPEC).alias("disagreement_index"))


INTERACTION_SQL = f"""{V} * {I} AS Apparent_Power_kVA, {I} * {D} AS Thermal_Loading_Index,
 {V} * 1e3 / (abs({I}) + 1e-5) AS Apparent_Impedance_Proxy"""
INTERACTION_NAMES = ["Apparent_Power_kVA", "Thermal_Loading_Index", "Apparent_Impedance_Proxy"]


@checks.check("q_interactions", sql_with(query=f"SELECT rid, {INTERACTION_SQL} FROM m"), INTERACTION_NAMES)
def interactions(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return df.select("rid", *[c.alias(n) for n, c in features.interactions(df, SPEC).items()])


def ratio_sql(a: str, b: str) -> str:
    return f"(coalesce({a}, 0) + 1e-5) / (abs(coalesce({b}, 0)) + 1e-5)"


CONTEXT = {"Apparent_Power_kVA": f"{V} * {I}", "Sensor_Spread": SPREAD, "Sensor_Mean": MEAN4,
           "Sensor_S1_S2_Ratio": ratio_sql(S1, S2), "Sensor_S3_S4_Ratio": ratio_sql(S3, S4)}
CONTEXT_SQL = ", ".join(f"{e} AS {n}" for n, e in CONTEXT.items())


@checks.check("q_ratios", sql_with(query=f"SELECT rid, {CONTEXT_SQL} FROM m"), list(CONTEXT))
def ratios(spark, sf_dir):
    df, _, names = features.with_context(measurements(spark, sf_dir), SPEC)
    return df.select("rid", *names)


REGIME_CODE = (f"CASE WHEN {I} IS NULL OR {V} IS NULL THEN 0 WHEN {I} > 85 AND {V} > 25 THEN 1 WHEN {I} > 85 THEN 2 "
               f"WHEN {V} > 25 THEN 3 ELSE 4 END")
NAME_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in features.REGIME_NAMES.items())
# A tenth of the currents is blanked so that unknown regimes occur.
HOLES = ("h", f"SELECT * REPLACE (CASE WHEN Test_ID % 10 = 3 THEN NULL ELSE {I} END AS {I}) FROM m")


def with_holes(df):
    return df.withColumn(I, F.expr(f"CASE WHEN Test_ID % 10 = 3 THEN NULL ELSE {I} END"))


@checks.check("q_regimes", sql_with(HOLES, query=f"""
SELECT rid, {REGIME_CODE} AS code, CASE {REGIME_CODE} {NAME_CASES} END AS name,
 CASE WHEN {I} > 85 AND {V} > 25 THEN 'Heavy HV Load' WHEN {I} > 85 THEN 'Heavy Current' WHEN {V} > 25 THEN 'High Voltage'
 ELSE 'Standard' END AS lenient FROM h"""))
def regimes(spark, sf_dir):
    df = with_holes(measurements(spark, sf_dir))
    return df.select("rid", features.regime_code(df, SPEC).alias("code"), features.regime_name(df, SPEC).alias("name"),
                     features.regime_name(df, SPEC, unknown=None).alias("lenient"))


@checks.check("q_current_band", sql_with(HOLES, ("q", f"""
SELECT quantile_cont({I}, 0.33) AS lo, quantile_cont({I}, 0.66) AS hi FROM h"""), query=f"""
SELECT rid, CASE WHEN {I} IS NULL THEN 'Unknown' WHEN {I} <= lo THEN 'Low_Current' WHEN {I} <= hi THEN 'Medium_Current'
 ELSE 'High_Current' END AS Current_Regime FROM h, q"""))
def current_band(spark, sf_dir):
    return features.with_current_band(with_holes(measurements(spark, sf_dir)), SPEC).select("rid", "Current_Regime")


@checks.check("q_regime_summary", sql_with(HOLES, query=f"""
SELECT {REGIME_CODE} AS Regime_Code, CASE {REGIME_CODE} {NAME_CASES} END AS Regime_Name, count(*) AS Total_Records,
 count(*) FILTER (WHERE Validity_Label = 'Valid') AS Valid_Count, count(*) FILTER (WHERE Validity_Label = 'Invalid') AS Invalid_Count,
 100e0 * count(*) FILTER (WHERE Validity_Label = 'Invalid') / count(*) AS Invalid_Rate_Pct, avg({I}) AS Mean_Current_A,
 avg({V}) AS Mean_Voltage_kV FROM h GROUP BY 1, 2"""), ["Invalid_Rate_Pct", "Mean_Current_A", "Mean_Voltage_kV"])
def regime_summary(spark, sf_dir):
    return features.regime_summary(with_holes(measurements(spark, sf_dir)), SPEC)


@checks.check("q_median_impute", sql_with(query="SELECT rid, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM m WHERE Test_ID % 4 <> 0)) AS {c}" for c in FEATURES)
    + " FROM m WHERE Test_ID % 4 = 0"), FEATURES)
def median_impute(spark, sf_dir):
    df = measurements(spark, sf_dir)
    fills = transforms.fit_medians(fitting_rows(df), FEATURES)
    return transforms.impute(scoring_rows(df), fills).select("rid", *FEATURES)


@checks.check("q_standardize", sql_with(query="SELECT rid, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM m WHERE Test_ID % 4 <> 0)) / (SELECT stddev_pop({c}) FROM m WHERE Test_ID % 4 <> 0) AS {c}"
    for c in FEATURES) + " FROM m WHERE Test_ID % 4 = 0"), FEATURES)
def standardize(spark, sf_dir):
    df = measurements(spark, sf_dir)
    scaling = transforms.fit_scaling(fitting_rows(df), FEATURES)
    return transforms.standardize(scoring_rows(df), scaling).select("rid", *FEATURES)


@checks.check("q_minmax", sql_with(("s", f"SELECT *, {PROBABILITY} AS p FROM m"), query="""
SELECT rid, (p - (SELECT min(p) FROM s)) / ((SELECT max(p) - min(p) FROM s) + 1e-5) AS scaled FROM s"""), ["scaled"])
def minmax(spark, sf_dir):
    return transforms.min_max(scored(spark, sf_dir), "p", "scaled").select("rid", "scaled")


@checks.check("q_consistency", sql_with(query="""
SELECT rid, greatest(a, b, c) AS p1_max_abs_residual, list_avg([a, b, c]) AS p1_mean_abs_residual, greatest(a, b, c) AS p1_residual_error,
 1e0 / (1e0 + coalesce(list_avg([a, b, c]), 0)) AS p1_consistency_index
FROM (SELECT rid, abs(Sensor_S1 - Sensor_S2) AS a, abs(Sensor_S1 - Sensor_S3) AS b, abs(Sensor_S3 - Sensor_S4) AS c FROM m)"""),
    ["p1_max_abs_residual", "p1_mean_abs_residual", "p1_residual_error", "p1_consistency_index"])
def consistency(spark, sf_dir):
    df = measurements(spark, sf_dir)
    gaps = [F.abs(number(df, a) - number(df, b)) for a, b in ((S1, S2), (S1, S3), (S3, S4))]
    return df.select("rid", *[c.alias(n) for n, c in transforms.consistency(gaps).items()])


def ridge_ctes(rows: str, alpha: float = 1.0) -> list[tuple[str, str]]:
    """CTEs that fit every sensor on the conditions over the Valid rows of ``rows`` by elimination; last: ``ridge``."""
    x, n = list(SPEC.conditions), len(SPEC.conditions)
    fit = f"SELECT * FROM {rows} WHERE Validity_Label = 'Valid'"
    medians = ", ".join(f"coalesce(median({c}), 0) AS d{i}" for i, c in enumerate(x))
    filled = ", ".join(f"coalesce({c}, d{i}) AS x{i}" for i, c in enumerate(x))
    cell = {(i, j): f"count(*) * covar_pop(x{i}, x{j})" + (f" + {alpha}" if i == j else "") for i in range(n) for j in range(n)}
    cell |= {(i, n): f"count(*) * covar_pop(x{i}, y)" for i in range(n)}
    sums = ", ".join(f"{e} AS a{i}{j}" for (i, j), e in cell.items())
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(n))
    ctes = [("fit", fit), ("med", f"SELECT {medians} FROM fit"), ("fx", f"SELECT fit.*, {filled} FROM fit, med"),
            ("g0", union_all(f"SELECT '{s}' AS sensor, avg(y) AS ym, {means}, {sums} FROM (SELECT *, {s} AS y FROM fx WHERE {s} IS NOT NULL)"
                             for s in SPEC.sensors))]
    for k in range(n):
        kept = {(i, j): f"a{i}{j}" if i <= k else f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k}" for i, j in cell}
        step = ", ".join(f"{e} AS a{i}{j}" for (i, j), e in kept.items())
        ctes.append((f"g{k + 1}", f"SELECT sensor, ym, {', '.join(f'm{i}' for i in range(n))}, {step} FROM g{k}"))
    source = f"g{n}"
    for i in reversed(range(n)):
        known = "".join(f" - a{i}{j} * w{j}" for j in range(i + 1, n))
        ctes.append((f"h{i}", f"SELECT *, (a{i}{n}{known}) / a{i}{i} AS w{i} FROM {source}"))
        source = f"h{i}"
    line = "ym" + "".join(f" - w{i} * m{i}" for i in range(n))
    return [*ctes, ("ridge", f"SELECT sensor, {line} AS c, {', '.join(f'w{i}' for i in range(n))} FROM {source}")]


def expected_sql(sensor: str) -> str:
    """The fitted expectation of a sensor over a row of a table with the conditions, and ``med``."""
    terms = "".join(f" + coalesce({c}, d{i}) * r_{sensor}.w{i}" for i, c in enumerate(SPEC.conditions))
    return f"r_{sensor}.c{terms}"


RIDGE_JOIN = ", med, " + ", ".join(f"(SELECT * FROM ridge WHERE sensor = '{s}') AS r_{s}" for s in SPEC.sensors)
PERFORMANCE = union_all(f"""SELECT '{s}' AS Target_Sensor, count({s}) AS Valid_Train_Count,
 1 - avg(({s} - e) * ({s} - e)) / var_pop({s}) AS R2_Score, avg(abs({s} - e)) AS MAE, sqrt(avg(({s} - e) * ({s} - e))) AS RMSE,
 '{", ".join(SPEC.conditions)}' AS Predictors FROM (SELECT fit.*, {expected_sql(s)} AS e FROM fit{RIDGE_JOIN})""" for s in SPEC.sensors)


@checks.check("q_normal_fit", sql_with(*ridge_ctes("m"), query=PERFORMANCE), ["R2_Score", "MAE", "RMSE"])
def normal_fit(spark, sf_dir):
    return transforms.fit_normal_behaviour(measurements(spark, sf_dir), SPEC).performance(measurements(spark, sf_dir))


ABSOLUTE = [f"abs({s} - e_{s})" for s in SPEC.sensors]
RESIDUALS = ", ".join(f"e_{s} AS {s}_Expected, {s} - e_{s} AS {s}_Residual, abs({s} - e_{s}) AS {s}_AbsResidual" for s in SPEC.sensors)
EXPECTED = ", ".join(f"{expected_sql(s)} AS e_{s}" for s in SPEC.sensors)
RESIDUAL_NAMES = [f"{s}_{k}" for s in SPEC.sensors for k in ("Expected", "Residual", "AbsResidual")] + [
    "p1_max_abs_residual", "p1_mean_abs_residual", "p1_residual_error", "p1_consistency_index", "p1_sensor_disagreement_index"]


RESIDUAL_SQL = f"""{RESIDUALS}, greatest({", ".join(ABSOLUTE)}) AS p1_max_abs_residual, list_avg([{", ".join(ABSOLUTE)}]) AS p1_mean_abs_residual,
 greatest({", ".join(ABSOLUTE)}) AS p1_residual_error, 1e0 / (1e0 + coalesce(list_avg([{", ".join(ABSOLUTE)}]), 0)) AS p1_consistency_index,
 ({SPREAD}) / (abs({MEAN4}) + 1e-5) AS p1_sensor_disagreement_index, {REGIME_CODE} AS p1_regime_cluster"""
TRAIN = ("train", "SELECT * FROM m WHERE Test_ID % 4 <> 0")


@checks.check("q_residuals", sql_with(
    TRAIN, *ridge_ctes("train"), ("e", f"SELECT m.*, {EXPECTED} FROM m{RIDGE_JOIN} WHERE Test_ID % 4 = 0"),
    query=f"SELECT rid, {RESIDUAL_SQL} FROM e"), RESIDUAL_NAMES)
def residuals(spark, sf_dir):
    df = measurements(spark, sf_dir)
    model = transforms.fit_normal_behaviour(fitting_rows(df), SPEC)
    out = model.transform(scoring_rows(df))
    return out.select("rid", *[c for c in out.columns if "Residual" in c or "Expected" in c or c.startswith("p1_")])


@checks.check("q_median_impute_inf", sql_with(query="SELECT rid, " + ", ".join(
    f"coalesce(CASE WHEN NOT isinf({c}) THEN {c} END, (SELECT median({c}) FROM m WHERE Test_ID % 4 <> 0 AND NOT isinf({c}))) AS {c}"
    for c in FEATURES) + " FROM m WHERE Test_ID % 4 = 0", variant="inf"), FEATURES)
def median_impute_inf(spark, sf_dir):
    """Infinities are missing to the imputer, in the fit and in use."""
    df = measurements(spark, sf_dir, "inf")
    return transforms.impute(scoring_rows(df), transforms.fit_medians(fitting_rows(df), FEATURES)).select("rid", *FEATURES)


@checks.check("q_context_adapter", sql_with(("r", EVIDENCE_SQL), query="""
SELECT rid, p1_max_abs_residual, p1_consistency_index, p1_sensor_disagreement_index FROM r"""),
    ["p1_max_abs_residual", "p1_consistency_index", "p1_sensor_disagreement_index"])
def context_adapter(spark, sf_dir):
    """A frame that already has residual features keeps them instead of the contextual ones."""
    df, found, names = features.with_context(with_evidence(measurements(spark, sf_dir)), SPEC)
    assert found
    return df.select("rid", *names)


@checks.check("q_feature_matrix", sql_with(query="SELECT rid, " + ", ".join(
    f"CASE WHEN NOT isinf({e}) THEN {e} END AS {n}" for n, e in
    {**{c: c for c in FEATURES}, "Apparent_Power_kVA": f"{V} * {I}"}.items()) + " FROM m", variant="inf"),
    [*FEATURES, "Apparent_Power_kVA"])
def feature_matrix(spark, sf_dir):
    df = features.row_features(measurements(spark, sf_dir, "inf"), SPEC)
    return features.feature_matrix(df, SPEC, [*FEATURES, "Apparent_Power_kVA"], keep=["rid"])
