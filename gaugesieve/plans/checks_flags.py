"""Checks of loading, row flags and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugesieve.functions.storage import new_path
from gaugesieve.operators import duplicates, flags
from gaugesieve.plans.measurements import COLUMNS, SPEC, measurements, scoring_rows, sql_with
from gaugesieve.plans.registry import Checks
from gaugesieve.sources import io

checks = Checks()
FEATURES = list(SPEC.features)
NUMERIC = [*FEATURES, SPEC.target_col]
V, I, T_, D = SPEC.conditions
S1, S2, S3, S4 = SPEC.sensors


def flags_sql(source: str = "m") -> str:
    """DuckDB text of the full flag set over numeric measurements."""
    null_any = " OR ".join(f"{c} IS NULL" for c in FEATURES)
    names = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in FEATURES)
    non_finite = " OR ".join(f"coalesce(isinf({c}), false)" for c in FEATURES)
    return f"""SELECT *, (missing_any::INT + non_finite_value::INT + duplicate_full_row::INT + duplicate_test_id::INT
 + malformed_numeric::INT + invalid_voltage::INT + invalid_current::INT + invalid_duration::INT
 + invalid_ambient_temp::INT) AS data_quality_issue_count,
 (missing_any OR non_finite_value OR duplicate_full_row OR duplicate_test_id OR malformed_numeric OR invalid_voltage
  OR invalid_current OR invalid_duration OR invalid_ambient_temp) AS data_quality_issue
FROM (SELECT *, ({null_any}) AS missing_any,
 coalesce(nullif(concat_ws(',', {names}), ''), 'None') AS missing_columns,
 ({V} IS NULL OR {I} IS NULL OR {T_} IS NULL OR {D} IS NULL) AS missing_critical_measurement,
 ({non_finite}) AS non_finite_value,
 row_number() OVER (PARTITION BY {", ".join(COLUMNS)}) > 1 AS duplicate_full_row,
 count(*) OVER (PARTITION BY Test_ID) > 1 AS duplicate_test_id,
 count(*) OVER (PARTITION BY {", ".join(FEATURES)}) > 1 AS duplicate_measurement_pair,
 false AS malformed_numeric,
 coalesce({V} < 0, false) AS invalid_voltage, coalesce({I} < 0, false) AS invalid_current,
 coalesce({D} <= 0, false) AS invalid_duration, coalesce({T_} < -273.15, false) AS invalid_ambient_temp,
 coalesce({S2} < 0, false) AS sensor_s2_negative,
 (coalesce({S1} = 0, false) OR coalesce({S2} = 0, false) OR coalesce({S3} = 0, false)) AS sensor_zero_reading
FROM {source})"""


@checks.check("q_load_measurements", sql_with(query="SELECT * FROM m"), NUMERIC)
def load_measurements(spark, sf_dir):
    path = _written(measurements(spark, sf_dir))
    return io.load_measurements(spark, path, SPEC, id_type=T.LongType())


@checks.check("q_load_unlabelled", sql_with(
    query="SELECT * EXCLUDE (Validity_Label, Reference_Parameter) FROM m WHERE Test_ID % 4 = 0"), FEATURES)
def load_unlabelled(spark, sf_dir):
    path = _written(scoring_rows(measurements(spark, sf_dir)), "csv")
    return io.load_measurements(spark, path, SPEC, "csv", labelled=False, id_type=T.LongType())


def _written(df: DataFrame, fmt: str = "parquet") -> str:
    """Write a table to a new folder under the session's shared folder and return its path."""
    path = new_path(df.sparkSession, "table")
    io.write_table(df, path, fmt)
    return path


@checks.check("q_flagged_from_csv", sql_with(
    query=f"""SELECT rid, Test_ID, ({V} IS NOT NULL AND try_cast({V} AS DOUBLE) IS NULL) AS malformed_numeric,
 ({" OR ".join(f"{c} IS NULL" for c in FEATURES)}) AS missing_any, try_cast({V} AS DOUBLE) AS {V}, {I} FROM m""", variant="text"), [V, I])
def flagged_from_csv(spark, sf_dir):
    """A CSV file with its columns in another order and unreadable numbers in it."""
    table = measurements(spark, sf_dir, "text")
    path = _written(table.select(*reversed(table.columns)), "csv")
    return io.load_flagged(spark, path, SPEC, fmt="csv", id_type=T.LongType()).select(
        "rid", "Test_ID", "malformed_numeric", "missing_any", V, I)


@checks.check("q_physical_matrix", sql_with(query=f"SELECT {', '.join(FEATURES)} FROM m"), FEATURES)
def physical_matrix(spark, sf_dir):
    return io.physical_matrix(measurements(spark, sf_dir), SPEC)


@checks.check("q_write_read_join", sql_with(
    ("s", "SELECT rid, sum(CASE WHEN Sensor_S4 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY Validity_Label) AS gaps FROM m"),
    query="SELECT m.rid, m.Test_ID, CAST(s.gaps AS BIGINT) AS gaps FROM m JOIN s ON m.rid = s.rid"))
def write_read_join(spark, sf_dir):
    """A stored result read back and joined by key."""
    df = measurements(spark, sf_dir)
    per_label = df.groupBy(SPEC.label_col).agg(F.count_if(F.col(S4).isNull()).alias("gaps"))
    stored = df.select("rid", SPEC.label_col).join(F.broadcast(per_label), SPEC.label_col).select("rid", "gaps")
    back = io.read_result(spark, _written(stored))
    return df.select("rid", SPEC.id_col).join(back, "rid")


@checks.check("q_quality_flags", sql_with(("f", flags_sql()), query="SELECT * FROM f"), NUMERIC)
def quality_flags(spark, sf_dir):
    return flags.quality_flags(measurements(spark, sf_dir), SPEC)


for variant in ("inf", "neg"):
    checks.check(f"q_quality_flags_{variant}", sql_with(("f", flags_sql()), query="SELECT * FROM f", variant=variant),
                 NUMERIC)(lambda spark, sf_dir, variant=variant: flags.quality_flags(
                     measurements(spark, sf_dir, variant), SPEC))


@checks.check("q_malformed", sql_with(
    query=f"""SELECT rid, Test_ID, ({V} IS NOT NULL AND try_cast({V} AS DOUBLE) IS NULL) AS malformed_numeric,
 try_cast({V} AS DOUBLE) AS voltage FROM m""", variant="text"), ["voltage"])
def malformed(spark, sf_dir):
    df = measurements(spark, sf_dir, "text")
    flagged = flags.row_flags(df, SPEC)
    return flagged.select("rid", SPEC.id_col, "malformed_numeric", flags.number(df, V).alias("voltage"))


@checks.check("q_suspicious", sql_with(("t", f"""SELECT *, coalesce({V} < 0, false) AS a, coalesce({I} < 0, false) AS b,
 coalesce({D} <= 0, false) AS c, coalesce({T_} < -273.15, false) AS d, coalesce({S2} < 0, false) AS e,
 concat_ws(',', {", ".join(f"CASE WHEN {s} = 0 THEN '{s}' END" for s in SPEC.sensors)}) AS z FROM m"""), query=f"""
SELECT rid, Test_ID, {V}, {I}, {T_}, {D}, concat_ws('; ', CASE WHEN a THEN 'invalid_negative_voltage' END,
 CASE WHEN b THEN 'invalid_negative_current' END, CASE WHEN c THEN 'invalid_duration_non_positive' END,
 CASE WHEN d THEN 'invalid_temp_below_absolute_zero' END, CASE WHEN e THEN 'sensor_s2_negative' END,
 CASE WHEN z <> '' THEN 'sensor_zero_reading(' || z || ')' END) AS SuspiciousFlags,
 a::INT + b::INT + c::INT + d::INT + e::INT + (z <> '')::INT AS Count
FROM t WHERE a OR b OR c OR d OR e OR z <> ''""", variant="neg"), [V, I, T_, D])
def suspicious(spark, sf_dir):
    return flags.suspicious_records(measurements(spark, sf_dir, "neg"), SPEC)


@checks.check("q_label_encoding", sql_with(
    query="""SELECT rid, CASE WHEN trim(' ' || Validity_Label || ' ') = 'Invalid' THEN 1 ELSE 0 END AS encoded,
 CASE WHEN Validity_Label = 'Invalid' THEN 'Invalid' ELSE 'Valid' END AS decoded FROM m"""))
def label_encoding(spark, sf_dir):
    df = measurements(spark, sf_dir).withColumn(
        SPEC.label_col, F.concat(F.lit(" "), SPEC.label_col, F.lit(" ")))
    encoded = flags.encode_label(SPEC)
    return df.select("rid", encoded.alias("encoded"), flags.decode_label(encoded, SPEC).alias("decoded"))


@checks.check("q_numeric_frame", sql_with(
    query="SELECT rid, " + ", ".join(f"CASE WHEN NOT isinf({c}) THEN {c} END AS {c}" for c in FEATURES) + " FROM m",
    variant="inf"), FEATURES)
def numeric_frame(spark, sf_dir):
    from gaugesieve.operators.features import feature_matrix
    return feature_matrix(measurements(spark, sf_dir, "inf"), SPEC, FEATURES, keep=["rid"])


HARD_SQL = " OR ".join(flags.HARD_FLAGS)


@checks.check("q_hard_mask", sql_with(("f", flags_sql()), query=f"SELECT rid, ({HARD_SQL}) AS hard FROM f"))
def hard_mask(spark, sf_dir):
    flagged = flags.quality_flags(measurements(spark, sf_dir), SPEC)
    return flagged.select("rid", flags.hard_mask(flagged).alias("hard"))


# Residual-like columns that both engines know exactly.
EVIDENCE = {
    "p1_max_abs_residual": "abs(Sensor_S1 - Sensor_S2)*6e0",
    "p1_consistency_index": "1e0/(1e0 + abs(Sensor_S1 - Sensor_S3))",
    "p1_sensor_disagreement_index": "abs(Sensor_S4 - Sensor_S1)/(abs(Sensor_S2) + 1e-5)",
}
EVIDENCE_SQL = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in EVIDENCE.items()) + " FROM m"


def with_evidence(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.expr(e) for n, e in EVIDENCE.items()})


@checks.check("q_evidence_mask", sql_with(("r", EVIDENCE_SQL), query="""
SELECT rid, coalesce(p1_max_abs_residual >= 10, false) OR coalesce(p1_consistency_index <= 0.10, false)
 OR coalesce(p1_sensor_disagreement_index >= 1.5, false) AS evidence FROM r"""))
def evidence_mask(spark, sf_dir):
    df = with_evidence(measurements(spark, sf_dir))
    return df.select("rid", flags.evidence_mask(df).alias("evidence"))


@checks.check("q_duplicate_flags", sql_with(("f", flags_sql()), query="""
SELECT rid, Test_ID, duplicate_full_row, duplicate_test_id, duplicate_measurement_pair FROM f""", variant="dup"))
def duplicate_flags(spark, sf_dir):
    return duplicates.duplicate_flags(measurements(spark, sf_dir, "dup"), SPEC).select(
        "rid", SPEC.id_col, *duplicates.DUPLICATE_FLAGS)


NON_ID = ", ".join(c for c in COLUMNS if c != SPEC.id_col)
COPIES = ("c", f"SELECT *, count(*) OVER (PARTITION BY {', '.join(COLUMNS)}) AS n FROM m")
GROUPS = ("g", f"SELECT count(*) AS size FROM c WHERE n > 1 GROUP BY {NON_ID}")


@checks.check("q_duplicate_report", sql_with(COPIES, GROUPS, query="""
SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS TotalDuplicateRows, count(*) AS UniqueDuplicateGroups,
 min(size) AS SmallestGroup, max(size) AS LargestGroup,
 coalesce((SELECT string_agg(CAST(Test_ID AS VARCHAR), ', ' ORDER BY Test_ID)
  FROM (SELECT Test_ID FROM c WHERE n > 1 ORDER BY Test_ID LIMIT 20)), 'None') AS AffectedTestIDs
FROM g""", variant="dup"))
def duplicate_report(spark, sf_dir):
    return duplicates.duplicate_report(measurements(spark, sf_dir, "dup"), SPEC)


@checks.check("q_duplicate_report_clean", sql_with(COPIES, GROUPS, query="""
SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS TotalDuplicateRows, count(*) AS UniqueDuplicateGroups,
 min(size) AS SmallestGroup, max(size) AS LargestGroup, 'None' AS AffectedTestIDs FROM g"""))
def duplicate_report_clean(spark, sf_dir):
    return duplicates.duplicate_report(measurements(spark, sf_dir), SPEC)


@checks.check("q_duplicate_group_sizes", sql_with(COPIES, GROUPS, query="""
SELECT size AS GroupSize, count(*) AS Groups FROM g GROUP BY size""", variant="dup"))
def duplicate_group_sizes(spark, sf_dir):
    return duplicates.duplicate_group_sizes(measurements(spark, sf_dir, "dup"), SPEC)


@checks.check("q_repeated_ids", sql_with(("v", f"""
SELECT Test_ID, count(*) AS n FROM m GROUP BY Test_ID, {', '.join(FEATURES)}"""), query="""
SELECT CAST(Test_ID AS VARCHAR) AS Test_ID, CAST(sum(n) AS BIGINT) AS RepeatCount,
 CASE WHEN min(n) > 1 THEN 'Exact Duplicate Measurements' ELSE 'Same Test_ID Differing Measurements' END
 AS Classification, 8 AS PhysicalFeaturesEvaluated
FROM v GROUP BY Test_ID HAVING sum(n) > 1""", variant="dup"))
def repeated_ids(spark, sf_dir):
    return duplicates.repeated_ids(measurements(spark, sf_dir, "dup"), SPEC)


@checks.check("q_flagged_loader", sql_with(("f", flags_sql()), query="SELECT * FROM f"), NUMERIC)
def flagged_loader(spark, sf_dir):
    path = _written(measurements(spark, sf_dir))
    return io.load_flagged(spark, path, SPEC, id_type=T.LongType())
