import pytest
from pyspark.sql import functions as F

from gaugesieve.operators import duplicates, flags
from gaugesieve.spec import MeasurementSpec

SPEC = MeasurementSpec()
COLUMNS = "Test_ID string, Applied_Voltage_kV double, Load_Current_A double, Ambient_Temperature_C double, " \
          "Test_Duration_min double, Sensor_S1 double, Sensor_S2 double, Sensor_S3 double, Sensor_S4 double"


def frame(spark, rows):
    base = [10.0, 50.0, 25.0, 30.0, 9.0, 9.1, 10.0, 50.0]
    return spark.createDataFrame([(i, *[base[k] if v == "." else v for k, v in enumerate(vs)]) for i, vs in rows], COLUMNS)


def test_infinite_is_not_missing_and_missing_is_not_infinite(spark):
    inf, nan = float("inf"), float("nan")
    df = frame(spark, [(f"T{k}", [v, *"......."]) for k, v in enumerate([10.0, nan, inf, -inf, 20.0])])
    out = {r.Test_ID: r for r in flags.quality_flags(df, SPEC).collect()}
    assert [out[f"T{k}"].non_finite_value for k in range(5)] == [False, False, True, True, False]
    assert [out[f"T{k}"].missing_any for k in range(5)] == [False, True, False, False, False]
    assert out["T1"].missing_columns == "Applied_Voltage_kV" and out["T0"].missing_columns == "None"
    assert out["T1"].missing_critical_measurement


def test_physical_flags_and_count(spark):
    df = frame(spark, [("A", [-5.0, *"......."]), ("B", [".", -10.0, -300.0, 0.0, 0.0, -2.0, ".", 0.0])])
    a, b = flags.quality_flags(df, SPEC).orderBy("Test_ID").collect()
    assert a.invalid_voltage and a.data_quality_issue_count == 1
    assert b.invalid_current and b.invalid_duration and b.invalid_ambient_temp and b.data_quality_issue_count == 3
    assert b.sensor_s2_negative and b.sensor_zero_reading
    found = {r.Test_ID: r for r in flags.suspicious_records(df, SPEC).collect()}
    assert found["B"].Count == 5 and "sensor_zero_reading(Sensor_S1,Sensor_S4)" in found["B"].SuspiciousFlags


def test_malformed_text(spark):
    df = frame(spark, [("A", list("........"))]).withColumn("Applied_Voltage_kV", F.lit("n/a"))
    assert flags.row_flags(df, SPEC).first().malformed_numeric


def test_full_duplicates_flag_all_but_one(spark):
    df = frame(spark, [("A", list("........")), ("A", list("........")), ("B", [11.0, *"......."])])
    out = flags.quality_flags(df, SPEC).collect()
    assert len(out) == 3
    assert sorted(r.duplicate_full_row for r in out) == [False, False, True]
    assert [r.duplicate_test_id for r in out if r.Test_ID == "A"] == [True, True]
    report = duplicates.duplicate_report(df, SPEC).first()
    assert (report.TotalDuplicateRows, report.UniqueDuplicateGroups, report.AffectedTestIDs) == (2, 1, "A, A")


def test_clean_table_reports_zero(spark):
    report = duplicates.duplicate_report(frame(spark, [("A", list("........"))]), SPEC).first()
    assert (report.TotalDuplicateRows, report.AffectedTestIDs) == (0, "None")


def test_repeated_ids_exact_and_differing(spark):
    df = frame(spark, [("A", list("........")), ("A", list("........")), ("B", list("........")), ("B", [12.0, *"......."])])
    out = {r.Test_ID: r.Classification for r in duplicates.repeated_ids(df, SPEC).collect()}
    assert out == {"A": "Exact Duplicate Measurements", "B": "Same Test_ID Differing Measurements"}


@pytest.mark.parametrize("hot_fraction,block", [(0.001, 100_000), (1.0, 7)])
@pytest.mark.parametrize("parts", [1, 13])
def test_hot_id_vector_and_copies(spark, hot_fraction, block, parts):
    """A third of the rows are copies, a third share an id, a third share a vector."""
    rows = [("COPY", list("........")) for _ in range(100)]
    rows += [("HOT", [1000.0 + k, *"......."]) for k in range(100)]
    rows += [(f"V{k}", [7.0, *"......."]) for k in range(100)]
    rows += [("LONE", [5000.0, *"......."])]
    df = frame(spark, rows).repartition(parts)
    out = duplicates.duplicate_flags(df, SPEC, salts=8, hot_fraction=hot_fraction, block=block).collect()
    assert len(out) == 301

    def count(prefix, flag):
        return sum(r[flag] for r in out if r.Test_ID.startswith(prefix))

    assert [count("COPY", f) for f in duplicates.DUPLICATE_FLAGS] == [99, 100, 100]
    assert [count("HOT", f) for f in duplicates.DUPLICATE_FLAGS] == [0, 100, 0]
    assert [count("V", f) for f in duplicates.DUPLICATE_FLAGS] == [0, 0, 100]
    assert [count("LONE", f) for f in duplicates.DUPLICATE_FLAGS] == [0, 0, 0]


def test_label_codec(spark):
    df = spark.createDataFrame([(" Invalid ",), ("Valid",), (None,)], "Validity_Label string")
    assert [r[0] for r in df.select(flags.encode_label(SPEC)).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(flags.encode_label(SPEC, trim=False)).collect()] == [0, 0, 0]
