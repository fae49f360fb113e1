"""Column profiles and table audits. Each report is one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gaugesieve.functions.rowwise import (
    INF, any_of, correlation, joined_names, mean_of, number, pairs_of, spread_of, true_or_false,
)
from gaugesieve.functions.scale import exact_quantiles, melt, quantile_columns
from gaugesieve.functions.storage import stored
from gaugesieve.operators.duplicates import duplicate_group_sizes, duplicate_report, repeated_ids
from gaugesieve.operators.flags import (
    DIAGNOSTIC_FLAGS, REPORTED_FLAGS, absent, quality_flags, suspicious_records,
)
from gaugesieve.spec import MeasurementSpec

# Reported percentiles.
PERCENTILES = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0, 99.5, 99.9)
OUTLIER_ENDS = (0.01, 0.25, 0.75, 0.99)
# End of fixed values.


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def tall(summary: DataFrame, rows: dict[str, dict[str, Column]], name: str) -> DataFrame:
    """Turn a one-row summary into one row per entry of ``rows``."""
    entries = [F.struct(F.lit(key).alias(name), *[c.alias(n) for n, c in cols.items()])
               for key, cols in rows.items()]
    return summary.select(F.inline(F.array(*entries)))


def first_ids(df: DataFrame, conditions: dict[str, Column], spec: MeasurementSpec,
              limit: int) -> DataFrame:
    """(Column, AffectedSampleIDs): the smallest ``limit`` ids meeting each condition, joined."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    hits = df.select(F.col(spec.id_col).alias("id"), F.explode(hit).alias("Column"))
    order = W.partitionBy("Column").orderBy("id")
    few = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("id").cast("string").alias("id"))))
    return few.groupBy("Column").agg(F.concat_ws(", ", listed["id"]).alias("AffectedSampleIDs"))


def _with_ids(report: DataFrame, df: DataFrame, conditions, spec, limit) -> DataFrame:
    if spec.id_col not in df.columns:
        return report.withColumn("AffectedSampleIDs", F.lit("None"))
    ids = first_ids(df, conditions, spec, limit)
    return report.join(F.broadcast(ids), "Column", "left").withColumn(
        "AffectedSampleIDs", F.coalesce("AffectedSampleIDs", F.lit("None")))


def missing_profile(df: DataFrame, spec: MeasurementSpec, max_ids: int = 10) -> DataFrame:
    gaps = {c: absent(df, c) for c in df.columns}
    summary = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(g).alias(f"n_{i}") for i, g in enumerate(gaps.values())])
    has_id = spec.id_col in df.columns
    rows = {
        c: {
            "DataType": F.lit(df.schema[c].dataType.simpleString()),
            "MissingCount": F.col(f"n_{i}"),
            "MissingPct": percent(F.col(f"n_{i}"), F.col("rows")),
            "AffectedCount": F.col(f"n_{i}") if has_id else F.lit(0).cast("long"),
        }
        for i, c in enumerate(gaps)
    }
    return _with_ids(tall(summary, rows, "Column"), df, gaps, spec, max_ids)


def nonfinite_profile(df: DataFrame, spec: MeasurementSpec, max_ids: int = 10) -> DataFrame:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    plus = {c: true_or_false(number(df, c) == INF) for c in numeric}
    minus = {c: true_or_false(number(df, c) == -INF) for c in numeric}
    summary = df.agg(F.count(F.lit(1)).alias("rows"), *[
        agg for i, c in enumerate(numeric)
        for agg in (F.count_if(plus[c]).alias(f"p_{i}"), F.count_if(minus[c]).alias(f"m_{i}"))])
    rows = {}
    for i, c in enumerate(numeric):
        both = F.col(f"p_{i}") + F.col(f"m_{i}")
        rows[c] = {"PosInfCount": F.col(f"p_{i}"), "NegInfCount": F.col(f"m_{i}"),
                   "TotalNonFiniteCount": both, "NonFinitePct": percent(both, F.col("rows"))}
    return _with_ids(tall(summary, rows, "Column"), df,
                     {c: plus[c] | minus[c] for c in numeric}, spec, max_ids)


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows plus n, min, max, mean and sample std of each column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = number(df, c)
        aggs += [F.count(v).alias(f"n_{i}"), F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}"),
                 F.avg(v).alias(f"avg_{i}"), F.stddev_samp(v).alias(f"std_{i}")]
    return df.agg(*aggs)


def numeric_statistics(df: DataFrame, spec: MeasurementSpec, quantiles: DataFrame | None = None) -> DataFrame:
    """Counts, ends, mean, median and deviation per feature; ``quantiles``, if given, holds the medians."""
    columns = spec.present(df)
    rows = {
        c: {"TotalCount": F.col("rows"), "ValidCount": F.col(f"n_{i}"),
            "MissingCount": F.col("rows") - F.col(f"n_{i}"), "Min": F.col(f"lo_{i}"),
            "Max": F.col(f"hi_{i}"), "Mean": F.col(f"avg_{i}"), "Std": F.col(f"std_{i}")}
        for i, c in enumerate(columns)
    }
    stats = tall(_moments(df, columns), rows, "Feature")
    if quantiles is None:
        quantiles = exact_quantiles(df, {c: number(df, c) for c in columns}, [0.5])
    medians = quantiles.filter(F.col("prob") == 0.5).select(
        F.col("feature").alias("Feature"), F.col("quantile").alias("Median"))
    return stats.join(F.broadcast(medians), "Feature", "left")


def percentile_name(p: float) -> str:
    return f"P{str(float(p)).replace('.', '_')}"


def percentile_table(df: DataFrame, spec: MeasurementSpec, percentiles=PERCENTILES, quantiles: DataFrame | None = None) -> DataFrame:
    """Exact percentiles per feature, linear between ranks; features without values are left out."""
    if quantiles is None:
        quantiles = exact_quantiles(df, {c: number(df, c) for c in spec.present(df)}, [p / 100 for p in percentiles])
    names = {p / 100: percentile_name(p) for p in percentiles}
    return quantile_columns(quantiles, names).withColumnRenamed("feature", "Feature")


def outlier_candidates(df: DataFrame, spec: MeasurementSpec, flagged: DataFrame | None = None,
                       quantiles: DataFrame | None = None) -> DataFrame:
    """One row per record and feature that trips the IQR, percentile or z-score rule.

    ``flagged`` and ``quantiles`` may hand in the flags and quantiles of ``df``.
    """
    flagged = quality_flags(df, spec) if flagged is None else flagged
    columns = spec.present(df)
    if quantiles is None:
        quantiles = exact_quantiles(df, {c: number(df, c) for c in columns}, OUTLIER_ENDS)
    quartiles = quantile_columns(quantiles, dict(zip(OUTLIER_ENDS, ("p1", "q1", "q3", "p99"))))
    moments = tall(_moments(df, columns), {
        c: {"mean": F.col(f"avg_{i}"), "std": F.col(f"std_{i}")} for i, c in enumerate(columns)}, "feature")
    bounds = quartiles.join(F.broadcast(moments), "feature")

    context = spec.present(df, (spec.voltage, spec.current, spec.temperature))
    keys = list(dict.fromkeys([*spec.row_key, spec.id_col]))
    flags = {"QualityIssueFlag": "data_quality_issue", "MissingAnyFlag": "missing_any",
             "SensorS2NegativeFlag": "sensor_s2_negative", "SensorZeroFlag": "sensor_zero_reading"}
    kept = flagged.select(*keys, *[F.col(c).alias(f"ctx_{c}") for c in context],
                          *[F.col(f).alias(n) for n, f in flags.items()],
                          *[number(flagged, c).alias(c) for c in columns])
    long = melt(kept, {c: F.col(c) for c in columns},
                [*keys, *[f"ctx_{c}" for c in context], *flags], "feature", "Value")

    v, iqr = F.col("Value"), F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    # A column with an infinity has no finite deviation; its z-scores count as 0.
    usable = (F.col("std") > 0) & (F.col("std") < float("inf"))
    z = F.when(usable, (v - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    rules = [((v < low) | (v > high), "IQR_Outlier"),
             ((v < F.col("p1")) | (v > F.col("p99")), "Percentile_Extreme_<P1_or_>P99"),
             (F.abs(z) > 3.0, "ZScore_Extreme")]
    return (
        long.join(F.broadcast(bounds), "feature")
        .filter(any_of([true_or_false(r) for r, _ in rules]))
        .select(*keys, F.col("feature").alias("Variable"), "Value",
                joined_names(rules, "; ").alias("TriggeringMethods"), z.alias("ZScore"),
                low.alias("IQR_Lower"), high.alias("IQR_Upper"), F.col("p1").alias("P1"),
                F.col("p99").alias("P99"), *[F.col(f"ctx_{c}").alias(c) for c in context], *flags)
    )


def sensor_correlations(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """Pearson matrix of the sensors, pairwise complete, one row per sensor."""
    sensors = spec.present(df, spec.sensors)
    summary = df.agg(*[correlation(number(df, a), number(df, b)).alias(f"{a}|{b}") for a, b in pairs_of(sensors)],
                     *[F.when(F.stddev_pop(number(df, s)) > 0, 1.0).alias(f"{s}|{s}") for s in sensors])

    def cell(a, b):
        return F.col(f"`{a}|{b}`") if f"{a}|{b}" in summary.columns else F.col(f"`{b}|{a}`")

    return tall(summary, {a: {b: cell(a, b) for b in sensors} for a in sensors}, "Sensor")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b))


def sensor_metrics(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    s = [number(df, c) for c in spec.present(df, spec.sensors)]
    metrics = [mean_of(s).alias("Sensor_Mean"), spread_of(s).alias("Sensor_Spread")]
    if len(s) == 4:
        metrics += [_ratio(s[0], s[1]).alias("S1_S2_Ratio"), _ratio(s[2], s[3]).alias("S3_S4_Ratio")]
    return df.select(*spec.row_key, *metrics)


def sensor_summary(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    s = [number(df, c) for c in spec.present(df, spec.sensors)]
    spread = spread_of(s)
    return df.agg(
        F.avg(spread).alias("mean_sensor_spread"), F.max(spread).alias("max_sensor_spread"),
        F.count_if(s[1] < 0).alias("sensor_s2_negative_count"),
        F.count_if(any_of([true_or_false(x == 0) for x in s])).alias("sensor_zero_count"),
        F.avg(_ratio(s[0], s[1])).alias("s1_s2_ratio_mean"),
        F.avg(_ratio(s[2], s[3])).alias("s3_s4_ratio_mean"))


def quality_summary(train: DataFrame, spec: MeasurementSpec, test: DataFrame | None = None) -> DataFrame:
    """Prevalence of each flag, its class split, and its prevalence in a second flagged frame."""
    flags = [f for f in REPORTED_FLAGS if f in train.columns]
    labelled = spec.label_col in train.columns
    label = F.col(spec.label_col) if labelled else None
    aggs = [F.count(F.lit(1)).alias("rows")]
    for f in flags:
        aggs.append(F.count_if(F.col(f)).alias(f"n_{f}"))
        if labelled:
            aggs += [F.count_if(F.col(f) & (label == spec.negative)).alias(f"v_{f}"),
                     F.count_if(F.col(f) & (label == spec.positive)).alias(f"i_{f}")]
    rows = {}
    for f in flags:
        n = F.col(f"n_{f}")
        kind = "Diagnostic Observation" if f in DIAGNOSTIC_FLAGS else "Definite Quality Failure"
        rows[f] = {"Category": F.lit(kind), "Train_Flagged_Count": n,
                   "Train_Prevalence_Pct": percent(n, F.col("rows"))}
        if labelled:
            v, i = F.col(f"v_{f}"), F.col(f"i_{f}")
            rows[f] |= {"Train_Valid_Count": v, "Train_Invalid_Count": i,
                        "Train_Valid_Pct": percent(v, n), "Train_Invalid_Pct": percent(i, n)}
    report = tall(train.agg(*aggs), rows, "Quality_Flag")
    if test is None:
        return report
    shared = [f for f in flags if f in test.columns]
    other = tall(
        test.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in shared]),
        {f: {"Test_Flagged_Count": F.col(f"n_{f}"),
             "Test_Prevalence_Pct": percent(F.col(f"n_{f}"), F.col("rows"))} for f in shared},
        "Quality_Flag")
    return report.join(F.broadcast(other), "Quality_Flag", "left")


def constant_features(df: DataFrame, candidates) -> DataFrame:
    """Per candidate: does it hold at most one distinct value, and which (or ``All NaN``)?"""
    columns = [c for c in candidates if c in df.columns]
    # The aggregates skip NULL, so a constant column has equal ends and an empty one has none.
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            col = F.nanvl(col, F.lit(None).cast("double"))
        aggs += [F.min(col).alias(f"lo_{i}"), F.max(col).alias(f"hi_{i}")]
    rows = {}
    for i, c in enumerate(columns):
        constant = F.col(f"lo_{i}").isNull() | (F.col(f"lo_{i}") == F.col(f"hi_{i}"))
        rows[c] = {"is_constant": constant, "constant_value": F.when(
            constant, F.coalesce(F.col(f"lo_{i}").cast("string"), F.lit("All NaN")))}
    return tall(df.agg(*aggs), rows, "feature")


def active_features(df: DataFrame, candidates) -> list[str]:
    """Candidate names, in order, without the constant ones. One aggregation job."""
    kept = {r["feature"] for r in constant_features(df, candidates).filter("NOT is_constant").collect()}
    return [c for c in candidates if c in kept]


def feature_summary(df: DataFrame, columns) -> DataFrame:
    columns = list(columns)
    rows = {
        c: {"data_type": F.lit(df.schema[c].dataType.simpleString()),
            "missing_count": F.col("rows") - F.col(f"n_{i}"),
            "missing_rate_pct": percent(F.col("rows") - F.col(f"n_{i}"), F.col("rows")),
            "mean": F.col(f"avg_{i}"), "std": F.col(f"std_{i}"),
            "min": F.col(f"lo_{i}"), "max": F.col(f"hi_{i}")}
        for i, c in enumerate(columns)
    }
    return tall(_moments(df, columns), rows, "feature_name")


def distribution_check(train: DataFrame, test: DataFrame, spec: MeasurementSpec, scores=(),
                       flags=("missing_any", "data_quality_issue", "sensor_s2_negative",
                              "sensor_zero_reading")) -> DataFrame:
    """Missing count, range and mean of each column in both splits; scores and flags on ``test``."""
    def profile(df, columns, prefix):
        return tall(_moments(df, columns), {
            c: {f"{prefix}_Missing": F.col("rows") - F.col(f"n_{i}"), f"{prefix}_Min": F.col(f"lo_{i}"),
                f"{prefix}_Max": F.col(f"hi_{i}"), f"{prefix}_Mean": F.col(f"avg_{i}")}
            for i, c in enumerate(columns)}, "Feature")

    both = [c for c in spec.features if c in train.columns and c in test.columns]
    report = profile(train, both, "Training").join(
        F.broadcast(profile(test, both + [c for c in scores if c in test.columns], "Test")),
        "Feature", "full")
    present = [f for f in flags if f in test.columns]
    if not present:
        return report
    rates = test.agg(*[F.count_if(F.col(f).isNull()).alias(f"m_{f}") for f in present], *[
        F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"r_{f}") for f in present])
    extra = tall(rates, {f: {"Test_Missing": F.col(f"m_{f}"), "Test_Mean": F.col(f"r_{f}")}
                         for f in present}, "Feature")
    return report.unionByName(extra, allowMissingColumns=True)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("__whole", whole).select(column, "n", percent(F.col("n"), F.col("__whole")).alias("pct"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are left out."""
    v = number(df, column)
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    data = df.select(v.alias("v")).filter("v IS NOT NULL").withColumn("ends", ends)
    lo, hi = F.col("ends.lo"), F.col("ends.hi")
    width = (hi - lo) / bins
    place = F.when(hi > lo, F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return data.groupBy(place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first(lo + place * width).alias("lower_edge"))


def five_number_summary(df: DataFrame, column: str, by: str) -> DataFrame:
    names = {0.0: "minimum", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "maximum"}
    q = exact_quantiles(df, {column: number(df, column)}, list(names), by=[by])
    return quantile_columns(q, names, by=[by]).drop("feature")


def crosstab(df: DataFrame, rows: str, columns: str, values) -> DataFrame:
    counts = df.groupBy(rows).pivot(columns, list(values)).count()
    return counts.na.fill(0, [str(v) for v in values])


def run_audit(train: DataFrame, test: DataFrame, spec: MeasurementSpec) -> dict[str, DataFrame]:
    """Every audit for both splits.

    A split's rows are stored once, with their flags, and one search finds all the quantiles that its reports need; the reports
    are lazy plans over these tables.
    """
    results, flagged = {}, {}
    probs = sorted({0.5, *OUTLIER_ENDS, *[p / 100 for p in PERCENTILES]})
    for split, given in (("train", train), ("test", test)):
        flags = flagged[split] = stored(quality_flags(given, spec), "flagged")
        df = flags.select(*[F.col(f"`{c}`") for c in given.columns])
        quantiles = exact_quantiles(df, {c: number(df, c) for c in spec.present(df)}, probs)
        results |= {
            f"missing_{split}": missing_profile(df, spec),
            f"non_finite_{split}": nonfinite_profile(df, spec),
            f"duplicates_{split}": duplicate_report(df, spec),
            f"duplicate_sizes_{split}": duplicate_group_sizes(df, spec),
            f"repeated_ids_{split}": repeated_ids(df, spec),
            f"statistics_{split}": numeric_statistics(df, spec, quantiles),
            f"percentiles_{split}": percentile_table(df, spec, quantiles=quantiles),
            f"suspicious_{split}": suspicious_records(df, spec),
            f"outliers_{split}": outlier_candidates(df, spec, flags, quantiles),
            f"sensor_correlations_{split}": sensor_correlations(df, spec),
            f"sensor_summary_{split}": sensor_summary(df, spec),
            f"sensor_metrics_{split}": sensor_metrics(df, spec),
            f"flags_{split}": flags,
        }
    results["summary"] = quality_summary(flagged["train"], spec, flagged["test"])
    return results
