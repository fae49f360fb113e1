"""Checks of column profiles and table audits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gaugesieve.operators import audit, flags
from gaugesieve.operators.features import row_features
from gaugesieve.plans.checks_flags import checks as flag_checks
from gaugesieve.plans.checks_flags import FEATURES, NUMERIC, S1, S2, S3, S4, I, T_, V, flags_sql
from gaugesieve.plans.measurements import COLUMNS, SPEC, fitting_rows, measurements, scored, scoring_rows, sql_with
from gaugesieve.plans.measurements import PROBABILITY
from gaugesieve.plans.registry import Checks, tagged, tagged_sql

checks = Checks()
TYPES = {"rid": "string", "Test_ID": "bigint", "Validity_Label": "string"}


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def ids_sql(condition: str, limit: int = 10) -> str:
    return (f"coalesce((SELECT string_agg(CAST(Test_ID AS VARCHAR), ', ' ORDER BY Test_ID) FROM (SELECT Test_ID FROM m "
            f"WHERE {condition} ORDER BY Test_ID LIMIT {limit})), 'None')")


@checks.check("q_missing_profile", sql_with(query=union_all(
    f"""SELECT '{c}' AS "Column", '{TYPES.get(c, "double")}' AS DataType, count(*) FILTER (WHERE {c} IS NULL) AS MissingCount,
 100e0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS MissingPct, count(*) FILTER (WHERE {c} IS NULL) AS AffectedCount,
 {ids_sql(f"{c} IS NULL")} AS AffectedSampleIDs FROM m""" for c in COLUMNS)), ["MissingPct"])
def missing_profile(spark, sf_dir):
    return audit.missing_profile(measurements(spark, sf_dir), SPEC)


@checks.check("q_nonfinite_profile", sql_with(query=union_all(
    f"""SELECT '{c}' AS "Column", count(*) FILTER (WHERE x = CAST('Infinity' AS DOUBLE)) AS PosInfCount,
 count(*) FILTER (WHERE x = CAST('-Infinity' AS DOUBLE)) AS NegInfCount, count(*) FILTER (WHERE isinf(x)) AS TotalNonFiniteCount,
 100e0 * count(*) FILTER (WHERE isinf(x)) / count(*) AS NonFinitePct,
 {ids_sql(f"isinf(CAST({c} AS DOUBLE))")} AS AffectedSampleIDs FROM (SELECT CAST({c} AS DOUBLE) AS x FROM m)"""
    for c in ["Test_ID", *NUMERIC]), variant="inf"), ["NonFinitePct"])
def nonfinite_profile(spark, sf_dir):
    return audit.nonfinite_profile(measurements(spark, sf_dir, "inf"), SPEC)


@checks.check("q_numeric_stats", sql_with(query=union_all(
    f"""SELECT '{c}' AS Feature, count(*) AS TotalCount, count({c}) AS ValidCount, count(*) - count({c}) AS MissingCount,
 min({c}) AS Min, max({c}) AS Max, avg({c}) AS Mean, median({c}) AS Median, stddev_samp({c}) AS Std FROM m""" for c in FEATURES)),
    ["Min", "Max", "Mean", "Median", "Std"])
def numeric_stats(spark, sf_dir):
    return audit.numeric_statistics(measurements(spark, sf_dir), SPEC)


PNAMES = [audit.percentile_name(p) for p in audit.PERCENTILES]


@checks.check("q_percentiles", sql_with(query=union_all(
    f"SELECT '{c}' AS Feature, " + ", ".join(
        f"quantile_cont({c}, {p / 100!r}) AS {n}" for p, n in zip(audit.PERCENTILES, PNAMES)) + " FROM m"
    for c in FEATURES)), PNAMES)
def percentiles(spark, sf_dir):
    return audit.percentile_table(measurements(spark, sf_dir), SPEC)


def outlier_sql(endless=()) -> tuple:
    """CTEs and query; ``endless`` columns hold infinities beyond P1 and P99 and have no z-scores."""
    def bounds(c):
        ends = ("CAST('-Infinity' AS DOUBLE) AS p1, CAST('Infinity' AS DOUBLE) AS p99, 0 AS mu, 0 AS sd" if c in endless else
                f"quantile_cont({c}, 0.01) AS p1, quantile_cont({c}, 0.99) AS p99, avg({c}) AS mu, stddev_samp({c}) AS sd")
        return f"SELECT '{c}' AS Variable, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, {ends} FROM m"

    long = union_all(
        f"""SELECT rid, Test_ID, '{c}' AS Variable, {c} AS Value, {V}, {I}, {T_}, data_quality_issue AS QualityIssueFlag,
 missing_any AS MissingAnyFlag, sensor_s2_negative AS SensorS2NegativeFlag, sensor_zero_reading AS SensorZeroFlag
 FROM f WHERE {c} IS NOT NULL""" for c in FEATURES)
    ctes = (("f", flags_sql()), ("st", union_all(bounds(c) for c in FEATURES)), ("l", long),
            ("j", """SELECT l.*, p1 AS P1, p99 AS P99, q1 - 1.5 * (q3 - q1) AS IQR_Lower, q3 + 1.5 * (q3 - q1) AS IQR_Upper,
 CASE WHEN sd > 0 THEN (Value - mu) / sd ELSE 0 END AS ZScore FROM l JOIN st USING (Variable)"""))
    query = """SELECT *, concat_ws('; ', CASE WHEN Value < IQR_Lower OR Value > IQR_Upper THEN 'IQR_Outlier' END,
 CASE WHEN Value < P1 OR Value > P99 THEN 'Percentile_Extreme_<P1_or_>P99' END,
 CASE WHEN abs(ZScore) > 3 THEN 'ZScore_Extreme' END) AS TriggeringMethods
FROM j WHERE Value < IQR_Lower OR Value > IQR_Upper OR Value < P1 OR Value > P99 OR abs(ZScore) > 3"""
    return ctes, query


OUTLIER_DOUBLES = ["Value", V, I, T_, "P1", "P99", "IQR_Lower", "IQR_Upper", "ZScore"]


@checks.check("q_outlier_candidates", sql_with(*outlier_sql()[0], query=outlier_sql()[1]), OUTLIER_DOUBLES)
def outlier_candidates(spark, sf_dir):
    return audit.outlier_candidates(measurements(spark, sf_dir), SPEC)


@checks.check("q_outlier_candidates_inf", sql_with(*outlier_sql((V,))[0], query=outlier_sql((V,))[1], variant="inf"), OUTLIER_DOUBLES)
def outlier_candidates_inf(spark, sf_dir):
    """Voltages with infinities among them: more than a hundredth at either end."""
    return audit.outlier_candidates(measurements(spark, sf_dir, "inf"), SPEC)


@checks.check("q_sensor_corr", sql_with(query=union_all(
    f"SELECT '{a}' AS Sensor, " + ", ".join(f"corr({a}, {b}) AS {b}" for b in SPEC.sensors) + " FROM m"
    for a in SPEC.sensors)), SPEC.sensors)
def sensor_corr(spark, sf_dir):
    return audit.sensor_correlations(measurements(spark, sf_dir), SPEC)


SPREAD = f"greatest({S1}, {S2}, {S3}, {S4}) - least({S1}, {S2}, {S3}, {S4})"


@checks.check("q_sensor_summary", sql_with(query=f"""
SELECT avg({SPREAD}) AS mean_sensor_spread, max({SPREAD}) AS max_sensor_spread,
 count(*) FILTER (WHERE {S2} < 0) AS sensor_s2_negative_count,
 count(*) FILTER (WHERE {S1} = 0 OR {S2} = 0 OR {S3} = 0 OR {S4} = 0) AS sensor_zero_count,
 avg(CASE WHEN {S2} <> 0 THEN {S1} / {S2} END) AS s1_s2_ratio_mean, avg(CASE WHEN {S4} <> 0 THEN {S3} / {S4} END) AS s3_s4_ratio_mean
FROM m"""), ["mean_sensor_spread", "max_sensor_spread", "s1_s2_ratio_mean", "s3_s4_ratio_mean"])
def sensor_summary(spark, sf_dir):
    return audit.sensor_summary(measurements(spark, sf_dir), SPEC)


MEAN4 = (f"(coalesce({S1}, 0) + coalesce({S2}, 0) + coalesce({S3}, 0) + coalesce({S4}, 0)) / "
         f"nullif(({S1} IS NOT NULL)::INT + ({S2} IS NOT NULL)::INT + ({S3} IS NOT NULL)::INT + ({S4} IS NOT NULL)::INT, 0)")


@checks.check("q_sensor_metrics", sql_with(query=f"""
SELECT rid, {MEAN4} AS Sensor_Mean, {SPREAD} AS Sensor_Spread, CASE WHEN {S2} <> 0 THEN {S1} / {S2} END AS S1_S2_Ratio,
 CASE WHEN {S4} <> 0 THEN {S3} / {S4} END AS S3_S4_Ratio FROM m"""),
    ["Sensor_Mean", "Sensor_Spread", "S1_S2_Ratio", "S3_S4_Ratio"])
def sensor_metrics(spark, sf_dir):
    return audit.sensor_metrics(measurements(spark, sf_dir), SPEC)


def _summary_row(f: str) -> str:
    kind = "Diagnostic Observation" if f in flags.DIAGNOSTIC_FLAGS else "Definite Quality Failure"
    valid = f"count(*) FILTER (WHERE {f} AND Validity_Label = 'Valid')"
    invalid = f"count(*) FILTER (WHERE {f} AND Validity_Label = 'Invalid')"
    n = f"count(*) FILTER (WHERE {f})"
    test = f"(SELECT {n} FROM ft)"
    return f"""SELECT '{f}' AS Quality_Flag, '{kind}' AS Category, {n} AS Train_Flagged_Count, 100e0 * {n} / count(*) AS Train_Prevalence_Pct,
 {valid} AS Train_Valid_Count, {invalid} AS Train_Invalid_Count, coalesce(100e0 * {valid} / nullif({n}, 0), 0) AS Train_Valid_Pct,
 coalesce(100e0 * {invalid} / nullif({n}, 0), 0) AS Train_Invalid_Pct, {test} AS Test_Flagged_Count,
 100e0 * {test} / (SELECT count(*) FROM ft) AS Test_Prevalence_Pct FROM f"""


@checks.check("q_quality_summary", sql_with(
    ("f", flags_sql("(SELECT * FROM m WHERE Test_ID % 4 <> 0)")), ("ft", flags_sql("(SELECT * FROM m WHERE Test_ID % 4 = 0)")),
    query=union_all(map(_summary_row, flags.REPORTED_FLAGS))),
    ["Train_Prevalence_Pct", "Train_Valid_Pct", "Train_Invalid_Pct", "Test_Prevalence_Pct"])
def quality_summary(spark, sf_dir):
    df = measurements(spark, sf_dir)
    return audit.quality_summary(flags.quality_flags(fitting_rows(df), SPEC), SPEC,
                                 flags.quality_flags(scoring_rows(df), SPEC))


@checks.check("q_constant_features", sql_with(("f", flags_sql()), query=union_all(
    f"""SELECT '{c}' AS feature, count(DISTINCT {c}) <= 1 AS is_constant, CASE WHEN count(DISTINCT {c}) <= 1
 THEN coalesce(CAST(min({c}) AS VARCHAR), 'All NaN') END AS constant_value FROM f""" for c in [*FEATURES, *flags.REPORTED_FLAGS])))
def constant_features(spark, sf_dir):
    flagged = flags.quality_flags(measurements(spark, sf_dir), SPEC)
    return audit.constant_features(flagged, [*FEATURES, *flags.REPORTED_FLAGS])


DERIVED = {"S1_minus_S2": f"{S1} - {S2}", "S3_minus_S4": f"{S3} - {S4}", "Apparent_Power_kVA": f"{V} * {I}",
           "max_minus_min_sensors": SPREAD}


@checks.check("q_feature_summary", sql_with(
    ("x", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in DERIVED.items()) + " FROM m"),
    query=union_all(f"""SELECT '{c}' AS feature_name, 'double' AS data_type, count(*) - count({c}) AS missing_count,
 100e0 * (count(*) - count({c})) / count(*) AS missing_rate_pct, avg({c}) AS mean, stddev_samp({c}) AS std,
 min({c}) AS min, max({c}) AS max FROM x""" for c in [*FEATURES, *DERIVED])),
    ["missing_rate_pct", "mean", "std", "min", "max"])
def feature_summary(spark, sf_dir):
    return audit.feature_summary(row_features(measurements(spark, sf_dir), SPEC), [*FEATURES, *DERIVED])


CHECKED = ["missing_any", "data_quality_issue", "sensor_s2_negative", "sensor_zero_reading"]


def _profile(source: str, prefix: str, columns) -> str:
    return union_all(f"""SELECT '{c}' AS Feature, count(*) - count({c}) AS {prefix}_Missing, min({c}) AS {prefix}_Min,
 max({c}) AS {prefix}_Max, avg({c}) AS {prefix}_Mean FROM {source}""" for c in columns)


@checks.check("q_distribution_check", sql_with(
    ("tr", "SELECT * FROM m WHERE Test_ID % 4 <> 0"), ("te", "SELECT *, (Test_ID % 101)/101e0 AS score FROM m WHERE Test_ID % 4 = 0"),
    ("f", flags_sql("(SELECT * FROM m WHERE Test_ID % 4 = 0)")),
    ("a", _profile("tr", "Training", FEATURES)), ("c", _profile("te", "Test", [*FEATURES, "score"])),
    query="""SELECT Feature, Training_Missing, Training_Min, Training_Max, Training_Mean, Test_Missing, Test_Min, Test_Max, Test_Mean
FROM a FULL JOIN c USING (Feature)
""" + "".join(f"""UNION ALL SELECT '{f}', NULL, NULL, NULL, NULL, 0, NULL, NULL, avg({f}::INT) FROM f
""" for f in CHECKED)),
    [f"{p}_{s}" for p in ("Training", "Test") for s in ("Min", "Max", "Mean")])
def distribution_check(spark, sf_dir):
    df = measurements(spark, sf_dir)
    test = flags.quality_flags(scoring_rows(df), SPEC).withColumn("score", F.expr("(Test_ID % 101)/101e0"))
    return audit.distribution_check(fitting_rows(df), test, SPEC, ["score"])


@checks.check("q_value_counts", sql_with(query="""
SELECT Validity_Label, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER () AS pct FROM m GROUP BY Validity_Label"""), ["pct"])
def value_counts(spark, sf_dir):
    return audit.value_counts(measurements(spark, sf_dir), SPEC.label_col)


@checks.check("q_event_counts", """SELECT event_type, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER () AS pct
FROM events GROUP BY event_type""", ["pct"])
def event_counts(spark, sf_dir):
    return audit.value_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


SCORED = ("s", f"SELECT *, {PROBABILITY} AS p FROM m")


@checks.check("q_histogram", sql_with(SCORED, ("e", "SELECT min(p) AS lo, max(p) AS hi FROM s"), query="""
SELECT CAST(least(floor((p - lo) / ((hi - lo) / 35)), 34) AS INT) AS bin, count(*) AS n,
 min(lo + least(floor((p - lo) / ((hi - lo) / 35)), 34) * ((hi - lo) / 35)) AS lower_edge FROM s, e GROUP BY 1"""), ["lower_edge"])
def histogram(spark, sf_dir):
    return audit.histogram(scored(spark, sf_dir), "p", 35)


@checks.check("q_five_number", sql_with(SCORED, query="""
SELECT Validity_Label, min(p) AS minimum, quantile_cont(p, 0.25) AS q1, median(p) AS median, quantile_cont(p, 0.75) AS q3,
 max(p) AS maximum FROM s GROUP BY Validity_Label"""), ["minimum", "q1", "median", "q3", "maximum"])
def five_number(spark, sf_dir):
    return audit.five_number_summary(scored(spark, sf_dir), "p", SPEC.label_col)


@checks.check("q_event_five_number", """SELECT event_type, min(value) AS minimum, quantile_cont(value, 0.25) AS q1,
 median(value) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS maximum FROM events GROUP BY event_type""",
    ["minimum", "q1", "median", "q3", "maximum"])
def event_five_number(spark, sf_dir):
    return audit.five_number_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")


@checks.check("q_crosstab", sql_with(SCORED, query="""
SELECT Validity_Label, count(*) FILTER (WHERE p < 4e-1) AS "0", count(*) FILTER (WHERE p >= 4e-1) AS "1" FROM s GROUP BY Validity_Label"""))
def crosstab(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("flag", (F.col("p") >= 0.4).cast("int"))
    return audit.crosstab(df, SPEC.label_col, "flag", [0, 1])


def _non_finite_sql() -> str:
    return union_all(f"""SELECT '{c}' AS "Column", 0::BIGINT AS PosInfCount, 0::BIGINT AS NegInfCount, 0::BIGINT AS TotalNonFiniteCount,
 0e0 AS NonFinitePct, 'None' AS AffectedSampleIDs""" for c in ["Test_ID", *FEATURES])


def _audit_sql() -> str:
    """The texts of all reports, each on the rows of its split."""
    texts = {}
    for split, where, labels in (("train", "Test_ID % 4 <> 0", True), ("test", "Test_ID % 4 = 0", False)):
        # Every text has its table m on a line of its own, whichever variant it is of.
        known = {n: re.sub(r"^m AS \(.*\)(?=,?$)", f"m AS (SELECT * FROM m0 WHERE {where})", t, flags=re.MULTILINE)
                 for n, t in (checks.sql | flag_checks.sql).items()}
        extra = f"UNION ALL SELECT '{SPEC.target_col}', 0, 0, 0, 0e0, 'None'" if labels else ""
        absent = "" if labels else f""" WHERE "Column" NOT IN ('{SPEC.label_col}', '{SPEC.target_col}')"""
        named = {
            "missing": f"SELECT * FROM ({known['q_missing_profile']}){absent}", "non_finite": f"{_non_finite_sql()} {extra}",
            "duplicates": known["q_duplicate_report_clean"], "duplicate_sizes": known["q_duplicate_group_sizes"],
            "repeated_ids": known["q_repeated_ids"],
            "statistics": known["q_numeric_stats"], "percentiles": known["q_percentiles"], "suspicious": known["q_suspicious"],
            "outliers": known["q_outlier_candidates"], "sensor_correlations": known["q_sensor_corr"],
            "sensor_summary": known["q_sensor_summary"], "sensor_metrics": known["q_sensor_metrics"],
            "flags": known["q_quality_flags"] if labels else f"SELECT * EXCLUDE ({SPEC.label_col}, {SPEC.target_col}) FROM ({known['q_quality_flags']})",
        }
        texts |= {f"{name}_{split}": text for name, text in named.items()}
    with_id = {n: f"SELECT * REPLACE (CAST(Test_ID AS VARCHAR) AS Test_ID) FROM ({t})" for n, t in texts.items()
               if n.startswith(("suspicious", "outliers", "flags", "repeated_ids"))}
    return tagged_sql(texts | with_id | {"summary": checks.sql["q_quality_summary"]})


@checks.check("q_audit_run", _audit_sql())
def audit_run(spark, sf_dir):
    """The rows of all reports of the whole audit on both splits; ids as text, as some reports have them."""
    df = measurements(spark, sf_dir)
    reports = audit.run_audit(fitting_rows(df), scoring_rows(df), SPEC)
    return tagged({name: report.withColumn(SPEC.id_col, F.col(SPEC.id_col).cast("string")) if SPEC.id_col in report.columns else report
                   for name, report in reports.items()})
