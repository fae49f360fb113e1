"""Features computed from one row: differences, aggregates, disagreement, interactions, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.rowwise import (
    finite, mean_of, median_of, number, pairs_of, short_name, spread_of, std_of,
)
from gaugesieve.functions.scale import exact_quantiles
from gaugesieve.operators.flags import encode_label
from gaugesieve.spec import MeasurementSpec

TINY = 1e-5
HEAVY_CURRENT_A = 85
HIGH_VOLTAGE_KV = 25

# Regime names by code.
REGIME_NAMES = {0: "Unknown", 1: "Heavy HV Load", 2: "Heavy Current", 3: "High Voltage", 4: "Standard"}
CONTEXT_MARKERS = (
    "p1_residual_error", "p1_regime_cluster", "p1_consistency_index", "p1_regime_abnormality",
    "p1_max_abs_residual", "p1_mean_abs_residual", "p1_sensor_disagreement_index",
)
# End of fixed values.


def _sensors(df: DataFrame, spec: MeasurementSpec) -> list[str]:
    return spec.present(df, spec.sensors)


def sensor_differences(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    return {f"{short_name(a)}_minus_{short_name(b)}": number(df, a) - number(df, b)
            for a, b in pairs_of(_sensors(df, spec))}


def sensor_aggregates(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    """Row mean, median and sample std over all sensors and over all but the last."""
    out = {}
    for group in (spec.sensors[:-1], spec.sensors):
        if set(group) <= set(df.columns):
            values = [number(df, s) for s in group]
            tail = "_".join(short_name(s) for s in group)
            out |= {f"sensor_mean_{tail}": mean_of(values), f"sensor_median_{tail}": median_of(values),
                    f"sensor_std_{tail}": std_of(values)}
    return out


def sensor_disagreement(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    names = _sensors(df, spec)
    if len(names) < 2:
        return {}
    gaps = [F.abs(number(df, a) - number(df, b)) for a, b in pairs_of(names)]
    widest = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return {"max_minus_min_sensors": spread_of([number(df, s) for s in names]),
            "pairwise_abs_diff_mean": mean_of(gaps), "pairwise_abs_diff_max": widest}


def interactions(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    has = set(df.columns)
    out = {}
    if {spec.voltage, spec.current} <= has:
        out["Apparent_Power_kVA"] = number(df, spec.voltage) * number(df, spec.current)
    if {spec.current, spec.duration} <= has:
        out["Thermal_Loading_Index"] = number(df, spec.current) * number(df, spec.duration)
    if {spec.voltage, spec.current} <= has:
        out["Apparent_Impedance_Proxy"] = (
            number(df, spec.voltage) * 1000.0 / (F.abs(number(df, spec.current)) + TINY))
    return out


def guarded_ratio(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit(0.0)) + TINY) / (F.abs(F.coalesce(b, F.lit(0.0))) + TINY)


def contextual_features(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    """Apparent power, sensor spread and mean, two guarded ratios; infinities become NULL."""
    out = {}
    if {spec.voltage, spec.current} <= set(df.columns):
        out["Apparent_Power_kVA"] = number(df, spec.voltage) * number(df, spec.current)
    if len(_sensors(df, spec)) == 4:
        s = [number(df, c) for c in spec.sensors]
        out |= {"Sensor_Spread": spread_of(s), "Sensor_Mean": mean_of(s)}
    for a, b in (spec.sensors[:2], spec.sensors[2:4]):
        if {a, b} <= set(df.columns):
            out[f"{a}_{short_name(b)}_Ratio"] = guarded_ratio(number(df, a), number(df, b))
    return {name: finite(value) for name, value in out.items()}


def with_context(df: DataFrame, spec: MeasurementSpec) -> tuple[DataFrame, bool, list[str]]:
    """Use residual features when the frame already has them, else add the contextual ones.

    Returns the frame, whether residual features were found, and the feature names.
    """
    if any(c in df.columns for c in CONTEXT_MARKERS):
        names = [c for c in df.columns if c.startswith("p1_") or "Residual" in c or "Expected" in c]
        return df, True, names
    extra = contextual_features(df, spec)
    return df.withColumns(extra), False, list(extra)


def regime_code(df: DataFrame, spec: MeasurementSpec) -> Column:
    def operand(name):
        return number(df, name) if name in df.columns else F.lit(0.0)

    c, v = operand(spec.current), operand(spec.voltage)
    heavy, high = c > HEAVY_CURRENT_A, v > HIGH_VOLTAGE_KV
    return (F.when(c.isNull() | v.isNull(), 0).when(heavy & high, 1).when(heavy, 2)
            .when(high, 3).otherwise(4))


def regime_name(df: DataFrame, spec: MeasurementSpec, unknown: str | None = "Unknown") -> Column:
    """Regime by name. ``unknown=None`` compares what is there and calls the rest Standard."""
    if unknown is None:
        c, v = number(df, spec.current), number(df, spec.voltage)
        heavy = F.coalesce(c > HEAVY_CURRENT_A, F.lit(False))
        high = F.coalesce(v > HIGH_VOLTAGE_KV, F.lit(False))
        return (F.when(heavy & high, REGIME_NAMES[1]).when(heavy, REGIME_NAMES[2])
                .when(high, REGIME_NAMES[3]).otherwise(REGIME_NAMES[4]))
    return name_of_code(regime_code(df, spec), unknown)


def name_of_code(code: Column, unknown: str = "Unknown") -> Column:
    named = F.when(code == 0, unknown)
    for number_, text in REGIME_NAMES.items():
        if number_:
            named = named.when(code == number_, text)
    return named


def with_current_band(df: DataFrame, spec: MeasurementSpec, out: str = "Current_Regime") -> DataFrame:
    """Low, medium and high current by the table's own 33rd and 66th percentile."""
    c = number(df, spec.current)
    cuts = exact_quantiles(df, {"current": c}, [0.33, 0.66]).agg(
        F.struct(F.min("quantile").alias("low"), F.max("quantile").alias("high")).alias("cuts")).scalar()
    band = (F.when(c.isNull(), "Unknown").when(c <= F.col("__cuts.low"), "Low_Current")
            .when(c <= F.col("__cuts.high"), "Medium_Current").otherwise("High_Current"))
    return df.withColumn("__cuts", cuts).withColumn(out, band).drop("__cuts")


def with_regimes(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    return with_current_band(df, spec).withColumn("Operating_Regime_Code", regime_code(df, spec))


def regime_summary(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    labelled = spec.label_col in df.columns
    label = F.col(spec.label_col)
    valid = F.count_if(label == spec.negative) if labelled else F.lit(None).cast("long")
    invalid = F.count_if(label == spec.positive) if labelled else F.lit(None).cast("long")
    rows = F.count(F.lit(1))
    summary = df.groupBy(regime_code(df, spec).alias("Regime_Code")).agg(
        rows.alias("Total_Records"), valid.alias("Valid_Count"), invalid.alias("Invalid_Count"),
        (invalid * 100.0 / rows).alias("Invalid_Rate_Pct"),
        F.avg(number(df, spec.current)).alias("Mean_Current_A"),
        F.avg(number(df, spec.voltage)).alias("Mean_Voltage_kV"))
    return summary.withColumn("Regime_Name", name_of_code(F.col("Regime_Code")))


def disagreement_index(df: DataFrame, spec: MeasurementSpec) -> Column:
    """Spread over the absolute row mean; needs all sensor columns."""
    if len(_sensors(df, spec)) < len(spec.sensors):
        return F.lit(None).cast("double")
    s = [number(df, c) for c in spec.sensors]
    return spread_of(s) / (F.abs(mean_of(s)) + TINY)


def row_features(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """All difference, aggregate, disagreement and interaction features in one projection."""
    return df.withColumns({
        **sensor_differences(df, spec), **sensor_aggregates(df, spec),
        **sensor_disagreement(df, spec), **interactions(df, spec)})


def matrix_columns(df: DataFrame, spec: MeasurementSpec, names=None) -> list[str]:
    """Feature columns of a frame; given names must all be there and none may be id or target."""
    if names is None:
        skipped = spec.never_features
        return [c for c in df.columns if c not in skipped]
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns are missing: {missing}")
    leaked = [c for c in names if c in spec.never_features]
    if leaked:
        raise ValueError(f"id or target columns cannot be features: {leaked}")
    return list(names)


def feature_matrix(df: DataFrame, spec: MeasurementSpec, names=None, keep=()) -> DataFrame:
    """Numeric, finite feature columns, preceded by ``keep`` columns."""
    columns = matrix_columns(df, spec, names)
    return df.select(*keep, *[finite(number(df, c)).alias(c) for c in columns])


def label_and_matrix(df: DataFrame, spec: MeasurementSpec, names) -> DataFrame:
    return feature_matrix(df, spec, names, keep=[*spec.row_key, encode_label(spec).alias("label")])
