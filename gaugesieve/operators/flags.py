"""Row-level quality flags. No row is ever dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugesieve.functions.rowwise import INF, any_of, count_true, joined_names, number, true_or_false
from gaugesieve.functions.storage import stored
from gaugesieve.operators.duplicates import DUPLICATE_FLAGS, duplicate_flags, duplicate_flags_by_fold
from gaugesieve.spec import MeasurementSpec

ABSOLUTE_ZERO_C = -273.15

# Flag names, in report order.
DEFINITE_FLAGS = (
    "missing_any", "non_finite_value", "duplicate_full_row", "duplicate_test_id",
    "malformed_numeric", "invalid_voltage", "invalid_current", "invalid_duration",
    "invalid_ambient_temp",
)
DIAGNOSTIC_FLAGS = ("duplicate_measurement_pair", "sensor_s2_negative", "sensor_zero_reading")
REPORTED_FLAGS = (
    "missing_any", "missing_critical_measurement", "non_finite_value", "duplicate_full_row",
    "duplicate_test_id", "duplicate_measurement_pair", "malformed_numeric", "invalid_voltage",
    "invalid_current", "invalid_duration", "invalid_ambient_temp", "sensor_s2_negative",
    "sensor_zero_reading", "data_quality_issue",
)
HARD_FLAGS = (
    "missing_critical_measurement", "non_finite_value", "invalid_voltage", "invalid_current",
    "invalid_duration", "invalid_ambient_temp", "malformed_numeric", "sensor_s2_negative",
    "sensor_zero_reading", "duplicate_measurement_pair",
)
SCORED_FLAGS = (
    "missing_any", "non_finite_value", "invalid_voltage", "invalid_current", "invalid_duration",
    "invalid_ambient_temp", "sensor_s2_negative", "sensor_zero_reading", "malformed_numeric",
    "data_quality_issue",
)
# End of fixed values.


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def absent(df: DataFrame, name: str) -> Column:
    """NULL or NaN in the raw column; unreadable text is present."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_flags(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    gaps = [(absent(df, c), c) for c in spec.present(df)]
    return {
        "missing_any": any_of([g for g, _ in gaps]),
        "missing_columns": joined_names(gaps, ",", "None"),
        "missing_critical_measurement": any_of([g for g, c in gaps if c in spec.conditions]),
    }


def non_finite_flag(df: DataFrame, spec: MeasurementSpec) -> Column:
    return any_of([true_or_false(F.abs(number(df, c)) == INF) for c in spec.present(df)])


def malformed_flag(df: DataFrame, spec: MeasurementSpec) -> Column:
    """A value is there but cannot be read as a number; only text columns can be malformed."""
    text = [c for c in spec.present(df) if _is_text(df, c)]
    return any_of([F.col(f"`{c}`").isNotNull() & number(df, c).isNull() for c in text])


def physical_flags(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    def test(name, condition):
        return true_or_false(condition(number(df, name))) if name in df.columns else F.lit(False)

    zero_tested = spec.sensors[:3]
    return {
        "invalid_voltage": test(spec.voltage, lambda v: v < 0),
        "invalid_current": test(spec.current, lambda v: v < 0),
        "invalid_duration": test(spec.duration, lambda v: v <= 0),
        "invalid_ambient_temp": test(spec.temperature, lambda v: v < ABSOLUTE_ZERO_C),
        "sensor_s2_negative": test(spec.sensors[1], lambda v: v < 0),
        "sensor_zero_reading": any_of([test(s, lambda v: v == 0) for s in zero_tested]),
    }


def row_flags(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """The flags that look at one row alone: a single projection."""
    flags = {
        **missing_flags(df, spec),
        "non_finite_value": non_finite_flag(df, spec),
        "malformed_numeric": malformed_flag(df, spec),
        **physical_flags(df, spec),
    }
    return df.withColumns(flags)


def quality_flags(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """All row flags, the three duplicate flags and the definite-issue count.

    Duplicate flags are relative to the frame given: another batch, another answer.
    """
    return definite_issues(df.columns, row_flags(duplicate_flags(df, spec), spec))


def definite_issues(columns, flagged: DataFrame) -> DataFrame:
    """``columns``, the flags in their order, and the definite-issue count of a frame that has all flags."""
    issues = count_true([F.col(f) for f in DEFINITE_FLAGS])
    order = [*columns, "missing_any", "missing_columns", "missing_critical_measurement",
             "non_finite_value", *DUPLICATE_FLAGS, "malformed_numeric", "invalid_voltage",
             "invalid_current", "invalid_duration", "invalid_ambient_temp",
             "sensor_s2_negative", "sensor_zero_reading"]
    return flagged.select(
        *[F.col(f"`{c}`") for c in order],
        issues.alias("data_quality_issue_count"),
        (issues > 0).alias("data_quality_issue"),
    )


def quality_flags_by_fold(folds: DataFrame, spec: MeasurementSpec, k: int):
    """A function of the split (1 to k) that gives the training and the validation rows with their quality flags.

    Duplicates are counted once for all splits; what a split needs is a projection and a filter.
    """
    columns = [c for c in folds.columns if c != "fold"]
    every = stored(row_flags(duplicate_flags_by_fold(folds, spec, k), spec), "fold_flags")

    def split(i: int) -> tuple[DataFrame, DataFrame]:
        here = every.withColumns({f: F.col(f)[i - 1] for f in ("duplicate_test_id", "duplicate_measurement_pair")})
        return tuple(definite_issues(columns, here.filter(c)) for c in (F.col("fold") != i, F.col("fold") == i))
    return split


def suspicious_records(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """Rows with at least one implausible value, and which. All four sensors count as zero here."""
    value = {c: number(df, c) for c in spec.present(df)}
    zeros = [(true_or_false(value[s] == 0), s) for s in spec.present(df, spec.sensors)]
    any_zero = any_of([z for z, _ in zeros])
    zero_tag = F.concat(F.lit("sensor_zero_reading("), joined_names(zeros, ","), F.lit(")"))
    checks = [
        (spec.voltage, lambda v: v < 0, "invalid_negative_voltage"),
        (spec.current, lambda v: v < 0, "invalid_negative_current"),
        (spec.duration, lambda v: v <= 0, "invalid_duration_non_positive"),
        (spec.temperature, lambda v: v < ABSOLUTE_ZERO_C, "invalid_temp_below_absolute_zero"),
        (spec.sensors[1], lambda v: v < 0, "sensor_s2_negative"),
    ]
    tags = [(true_or_false(rule(value[c])), tag) for c, rule, tag in checks if c in value]
    tags.append((any_zero, zero_tag))
    return (
        df.filter(any_of([t for t, _ in tags]))
        .select(*dict.fromkeys([*spec.row_key, spec.id_col]), *spec.present(df, spec.conditions),
                joined_names(tags, "; ").alias("SuspiciousFlags"),
                count_true([t for t, _ in tags]).alias("Count"))
    )


def encode_label(spec: MeasurementSpec, trim: bool = True) -> Column:
    label = F.col(spec.label_col)
    return F.coalesce((F.trim(label) if trim else label) == spec.positive, F.lit(False)).cast("int")


def decode_label(flag: Column, spec: MeasurementSpec) -> Column:
    return F.when(flag == 1, F.lit(spec.positive)).otherwise(F.lit(spec.negative))


def hard_mask(df: DataFrame) -> Column:
    """Any hard-corruption flag; ``missing_any`` is deliberately not one of them."""
    return any_of([F.coalesce(F.col(c), F.lit(False)) for c in HARD_FLAGS if c in df.columns])


def evidence_mask(df: DataFrame, residual: float = 10.0, consistency: float = 0.10,
                  disagreement: float = 1.5) -> Column:
    rules = {
        "p1_max_abs_residual": lambda v: v >= residual,
        "p1_consistency_index": lambda v: v <= consistency,
        "p1_sensor_disagreement_index": lambda v: v >= disagreement,
    }
    return any_of([true_or_false(rule(number(df, c))) for c, rule in rules.items() if c in df.columns])
