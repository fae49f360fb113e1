"""How the two classes of a labelled history differ."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.rowwise import correlation, number, pairs_of, true_or_false
from gaugesieve.functions.ranks import label_rank_sums, pair_correlations
from gaugesieve.functions.scale import exact_quantiles, melt, quantile_columns
from gaugesieve.functions.stats import correlation_p_value
from gaugesieve.functions.storage import outlasting, scratch, stored
from gaugesieve.operators.audit import percent, tall
from gaugesieve.operators.features import regime_summary, with_context, with_regimes
from gaugesieve.operators.flags import absent, encode_label, quality_flags
from gaugesieve.operators.transforms import fit_normal_behaviour
from gaugesieve.spec import MeasurementSpec

# Features compared between the classes beyond the raw measurements.
COMPARED_EXTRAS = ("Apparent_Power_kVA", "Sensor_Spread", "Sensor_Mean",
                   "Sensor_S1_S2_Ratio", "Sensor_S3_S4_Ratio")
HYPOTHESES = (
    "Apparent_Power_kVA x Sensor_Spread (Heavy-load sensor interaction)",
    "Ambient_Temperature_C x Load_Current_A (Thermal loading interaction)",
)
# End of fixed values.


def enrich(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """Quality flags plus contextual features."""
    return with_context(quality_flags(df, spec), spec)[0]


def compared_columns(df: DataFrame, spec: MeasurementSpec) -> list[str]:
    return spec.present(df, [*spec.features, *COMPARED_EXTRAS])


def class_balance(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    label = F.col(spec.label_col)
    n, v, i = (F.count(F.lit(1)), F.count_if(label == spec.negative), F.count_if(label == spec.positive))
    return df.agg(
        n.alias("TotalRecords"), v.alias("ValidCount"), percent(v, n).alias("ValidPct"),
        i.alias("InvalidCount"), percent(i, n).alias("InvalidPct"),
        F.try_divide(v, i).alias("ImbalanceRatio"), F.count_distinct(label).alias("ClassesFound"))


def _per_class(df: DataFrame, spec: MeasurementSpec, columns) -> DataFrame:
    """One row of class-conditional count, missing, mean, variance for every column, and its correlation with the label.

    Counts, means and squares are taken once per class, rows of neither class being a third; the correlation with the 0/1 label follows from them.
    """
    label = F.col(spec.label_col)
    group = F.when(label == spec.negative, "v").when(label == spec.positive, "i").otherwise("o")
    wide = df.select(group.alias("class"), *[number(df, c).alias(f"x{k}") for k, c in enumerate(columns)])
    sums = wide.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), *[a.alias(f"{name}{k}") for k in range(len(columns)) for name, a in (
        ("n", F.count(f"x{k}")), ("mean", F.avg(f"x{k}")), ("var", F.var_pop(f"x{k}")), ("lo", F.min(f"x{k}")), ("hi", F.max(f"x{k}")))])

    def of(tag: str, name: str) -> Column:
        return F.max(F.when(F.col("class") == tag, F.col(name)))

    aggs = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.coalesce(of(tag, "rows"), F.lit(0)).alias(f"{tag}_rows") for tag in "vi"]]
    for k in range(len(columns)):
        aggs += [F.struct(*[of(tag, f"{name}{k}").alias(name) for name in ("n", "mean", "var")]).alias(f"{tag}{k}") for tag in "vio"]
        lo, hi = F.min(f"lo{k}"), F.max(f"hi{k}")
        aggs.append(((lo < hi) | (F.abs(lo) == float("inf"))).alias(f"varies{k}"))
    out = [F.col("rows"), F.col("v_rows"), F.col("i_rows")]
    for k in range(len(columns)):
        for tag in "vi":
            n = F.coalesce(F.col(f"{tag}{k}.n"), F.lit(0))
            var = F.try_divide(F.col(f"{tag}{k}.var") * n, n - 1)
            out += [n.alias(f"{tag}_n_{k}"), F.col(f"{tag}{k}.mean").alias(f"{tag}_mean_{k}"),
                    F.sqrt(var).alias(f"{tag}_std_{k}"), var.alias(f"{tag}_var_{k}")]
        out.append(F.when(F.col(f"varies{k}"), _correlation_of([F.col(f"{tag}{k}") for tag in "ivo"])).alias(f"r_{k}"))
    return sums.agg(*aggs).select(*out)


def _correlation_of(groups: list[Column]) -> Column:
    """Pearson correlation of a number with belonging to the first of the groups, from their counts, means and variances."""
    def total(terms) -> Column:
        return reduce(add, [F.coalesce(t, F.lit(0.0)) for t in terms])

    base = F.coalesce(*[g["mean"] for g in groups])
    n, rest = total(g["n"].cast("double") for g in groups), total(g["n"].cast("double") for g in groups[1:])
    mid, other = (F.try_divide(total(g["n"] * (g["mean"] - base) for g in part), m) for part, m in ((groups, n), (groups[1:], rest)))
    squares = total(g["n"] * (g["var"] + (g["mean"] - base - mid) * (g["mean"] - base - mid)) for g in groups)
    share = F.sqrt((n - rest) * rest)
    apart = F.coalesce(groups[0]["mean"] - base - other, F.lit(0.0))
    return F.try_divide(apart * share * share, F.sqrt(n) * F.sqrt(squares) * share)


def cohens_d(k, undefined=None) -> Column:
    """Standardised mean difference with the pooled sample deviation; 0 when there is no spread."""
    nv, ni = F.col(f"v_n_{k}"), F.col(f"i_n_{k}")
    pooled = F.sqrt(F.try_divide((nv - 1) * F.col(f"v_var_{k}") + (ni - 1) * F.col(f"i_var_{k}"), nv + ni - 2))
    d = F.when((pooled > 0) & (pooled < float("inf")), F.try_divide(F.col(f"i_mean_{k}") - F.col(f"v_mean_{k}"), pooled)).otherwise(F.lit(0.0))
    return F.when((nv > 1) & (ni > 1), d).otherwise(F.lit(undefined).cast("double"))


def class_statistics(df: DataFrame, spec: MeasurementSpec, columns=None) -> DataFrame:
    """Count, missing rate, moments and percentiles of each feature, per class, side by side."""
    if columns is None:
        df = with_context(df, spec)[0]
        columns = compared_columns(df, spec)
    rows = {}
    for k, c in enumerate(columns):
        rows[c] = {}
        for tag, name in (("v", "Valid"), ("i", "Invalid")):
            n = F.col(f"{tag}_n_{k}")
            rows[c] |= {f"{name}_Count": n,
                        f"{name}_Missing_Rate_Pct": percent(F.col(f"{tag}_rows") - n, F.col(f"{tag}_rows")),
                        f"{name}_Mean": F.col(f"{tag}_mean_{k}"), f"{name}_Std": F.col(f"{tag}_std_{k}")}
    stats = tall(_per_class(df, spec, columns), rows, "Feature")
    label = F.col(spec.label_col)
    named = df.filter(label.isin(spec.positive, spec.negative)).withColumn(
        "__class", F.when(label == spec.positive, "Invalid").otherwise("Valid"))
    points = {0.01: "P1", 0.25: "P25", 0.5: "Median", 0.75: "P75", 0.99: "P99"}
    q = quantile_columns(
        exact_quantiles(named, {c: number(df, c) for c in columns}, list(points), by=["__class"]),
        points, by=["__class"])
    wide = q.groupBy(F.col("feature").alias("Feature")).agg(*[
        F.max(F.when(F.col("__class") == name, value)).alias(f"{name}_{out}")
        for name in ("Valid", "Invalid")
        for out, value in [*((p, F.col(p)) for p in points.values()), ("IQR", F.col("P75") - F.col("P25"))]])
    return stats.join(F.broadcast(wide), "Feature", "left")


def spearman_with_label(table: DataFrame, columns, label: Column) -> DataFrame:
    """Spearman's rho of every column of a stored table with the 0/1 ``label``, average ranks for ties: (feature, rho).

    Ranking a two-valued variable is a linear map of it, so rho is the Pearson
    correlation of the value ranks with the label: the positives' ranks and the ties tell it.
    """
    n, p = F.col("n"), F.col("positives")
    var_rank = (n * n * n - n - F.col("ties")) / 12
    rho = F.try_divide(F.col("shifted"), F.sqrt(var_rank * (p - p * p / n)))
    names = F.array(*[F.lit(c) for c in columns])
    return label_rank_sums(table, [F.col(f"`{c}`") for c in columns], label).select(names[F.col("k")].alias("feature"), rho.alias("rho"))


def label_associations(df: DataFrame, spec: MeasurementSpec, columns=None, min_values: int = 10) -> DataFrame:
    """Point-biserial and Spearman correlation with the label, p-values, effect size, missing rates."""
    if columns is None:
        df = with_context(df, spec)[0]
        columns = compared_columns(df, spec)
    columns, rows = list(dict.fromkeys(columns)), {}
    for k, c in enumerate(columns):
        rates = {f"{name}_Missing_Rate_Pct": percent(F.col(f"{t}_rows") - F.col(f"{t}_n_{k}"), F.col(f"{t}_rows"))
                 for t, name in (("v", "Valid"), ("i", "Invalid"))}
        rows[c] = {"n": F.col(f"v_n_{k}") + F.col(f"i_n_{k}"), "PointBiserial_Corr": F.col(f"r_{k}"),
                   "Cohens_D_EffectSize": cohens_d(k), **rates}
    # The columns are derived once, for the moments and the ranks, and deleted when both are known.
    with scratch(df.sparkSession):
        table = stored(df.select(*[number(df, c).alias(c) for c in columns], F.col(spec.label_col)), "numbers")
        stats = tall(_per_class(table, spec, columns), rows, "Feature").filter(F.col("n") >= min_values)
        rho = spearman_with_label(table, columns, encode_label(spec, trim=False))
        joined = outlasting(stats.join(F.broadcast(rho.withColumnRenamed("feature", "Feature")), "Feature", "left"), "associations")
    n = F.col("n").cast("double")
    return joined.select(
        "Feature", "PointBiserial_Corr",
        correlation_p_value("PointBiserial_Corr", n).alias("PointBiserial_PValue"),
        F.col("rho").alias("Spearman_Corr"), correlation_p_value("rho", n).alias("Spearman_PValue"),
        "Cohens_D_EffectSize", "Valid_Missing_Rate_Pct", "Invalid_Missing_Rate_Pct")


def patterns(df: DataFrame, spec: MeasurementSpec) -> dict[str, Column]:
    """Named predicates over an enriched frame; those whose column is absent are left out."""
    def above(name, limit):
        return (name, lambda: number(df, name) > limit)

    # Pattern names and limits.
    rules = {
        "Missing Sensor S4": (spec.sensors[-1], lambda: absent(df, spec.sensors[-1])),
        "Missing Any Feature": ("missing_any", lambda: F.col("missing_any")),
        "Negative Sensor S2": ("sensor_s2_negative", lambda: F.col("sensor_s2_negative")),
        "Zero Sensor Reading": ("sensor_zero_reading", lambda: F.col("sensor_zero_reading")),
        "High Sensor Spread (>50)": above("Sensor_Spread", 50),
        "High Load Current (>95A)": above(spec.current, 95),
        "High Applied Voltage (>28kV)": above(spec.voltage, 28),
        "Low Applied Voltage (<12kV)": (spec.voltage, lambda: number(df, spec.voltage) < 12),
        "High Ambient Temp (>45C)": above(spec.temperature, 45),
        "Long Test Duration (>90min)": above(spec.duration, 90),
        "High Apparent Power (>2000kVA)": above("Apparent_Power_kVA", 2000),
        "Definite Quality Issue": ("data_quality_issue", lambda: F.col("data_quality_issue")),
        "Duplicate Measurement Pair": ("duplicate_measurement_pair", lambda: F.col("duplicate_measurement_pair")),
    }
    return {name: true_or_false(rule()) for name, (col, rule) in rules.items() if col in df.columns}


def pattern_lift(df: DataFrame, spec: MeasurementSpec, predicates: dict[str, Column] | None = None) -> DataFrame:
    """Class counts and lift over the base rate for every pattern that occurs.

    One conditional aggregate over the table; the caller orders the few rows.
    """
    if predicates is None:
        df = enrich(df, spec)
        predicates = patterns(df, spec)
    label = F.col(spec.label_col)
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(label == spec.positive).alias("base")]
    for k, p in enumerate(predicates.values()):
        aggs += [F.count_if(p).alias(f"t_{k}"), F.count_if(p & (label == spec.negative)).alias(f"v_{k}"),
                 F.count_if(p & (label == spec.positive)).alias(f"i_{k}")]
    base = F.try_divide(F.col("base"), F.col("rows"))
    rows = {}
    for k, name in enumerate(predicates):
        t, v, i = (F.col(f"{x}_{k}") for x in "tvi")
        lift = F.when(base > 0, F.try_divide(F.try_divide(i, t), base)).otherwise(F.lit(0.0))
        rows[name] = {"Total_Records": t, "Valid_Count": v, "Invalid_Count": i,
                      "Invalid_Rate_Pct": percent(i, t), "Valid_Rate_Pct": percent(v, t),
                      "Baseline_Invalid_Rate_Pct": base * 100.0, "Lift_vs_Baseline": lift}
    return tall(df.agg(*aggs), rows, "Pattern_Name").filter("Total_Records > 0").orderBy(
        F.desc("Lift_vs_Baseline"), "Pattern_Name")


def _first_of_each(df: DataFrame, cases, order, columns, limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows, in id order, of each (tag, condition) case.

    Each row is read once and carries the cases it belongs to; per case only the first rows of every partition move.
    """
    tags = F.array(*[F.when(true_or_false(condition), F.lit(tag)) for tag, condition in cases])
    shown = df.select(F.struct(*columns).alias("shown"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)],
                      F.explode(F.array_compact(tags)).alias("case"))
    place = F.row_number().over(W.partitionBy("case").orderBy(*[f"o{i}" for i in range(len(order))]))
    return shown.withColumn("place", place).filter(F.col("place") <= limit).select(F.col("case").alias(name), "shown.*")


def _order(spec: MeasurementSpec) -> list[str]:
    return list(dict.fromkeys([spec.id_col, *spec.row_key]))


def unusual_regimes(df: DataFrame, spec: MeasurementSpec, limit: int = 5) -> DataFrame:
    df = enrich(df, spec)
    label, v, c, t = (F.col(spec.label_col), number(df, spec.voltage), number(df, spec.current),
                      number(df, spec.temperature))
    # Case names and limits.
    cases = [
        ("Unusual Heavy-Load (Valid)", (c > 95) & (label == spec.negative)),
        ("High Voltage Regime (Valid)", (v > 28) & (label == spec.negative)),
        ("Normal Operating Range (Invalid)",
         v.between(15, 25) & c.between(50, 80) & t.between(20, 35) & ~F.col("missing_any")
         & (label == spec.positive)),
    ]
    columns = [*_order(spec), spec.voltage, spec.current, spec.temperature, "Sensor_Spread", spec.label_col]
    return _first_of_each(df, cases, _order(spec), columns, limit, "Regime_Category")


def variable_shortlist(df: DataFrame, spec: MeasurementSpec, always_strong=None,
                       associations: DataFrame | None = None, hypotheses=HYPOTHESES) -> DataFrame:
    """Evidence category of every feature by absolute effect size, plus untested hypotheses as C."""
    forced = [spec.sensors[-1], "Sensor_Spread"] if always_strong is None else list(always_strong)
    table = label_associations(df, spec) if associations is None else associations
    d = F.abs(F.coalesce("Cohens_D_EffectSize", F.lit(0.0)))
    category = F.when((d > 0.5) | F.col("Feature").isin(forced), "A").when(d > 0.2, "B").otherwise("C")
    untested = df.sparkSession.createDataFrame(
        [(text, "C", None) for text in hypotheses], "Feature string, Category string, Abs_Effect double")
    return table.select("Feature", category.alias("Category"), d.alias("Abs_Effect")).union(untested)


def feature_evaluation(df: DataFrame, spec: MeasurementSpec, columns, min_values: int = 10) -> DataFrame:
    """Class means and correlation with the label for features that vary."""
    columns = list(columns)
    summary = _per_class(df, spec, columns)
    rows = {
        c: {"n": F.col(f"v_n_{k}") + F.col(f"i_n_{k}"), "valid_mean": F.col(f"v_mean_{k}"),
            "invalid_mean": F.col(f"i_mean_{k}"), "pearson_r": F.col(f"r_{k}")}
        for k, c in enumerate(columns)
    }
    ends = tall(df.agg(*[a for k, c in enumerate(columns) for a in (
        F.min(number(df, c)).alias(f"lo_{k}"), F.max(number(df, c)).alias(f"hi_{k}"))]),
        {c: {"varies": F.col(f"lo_{k}") < F.col(f"hi_{k}")} for k, c in enumerate(columns)}, "feature_name")
    r = F.abs(F.col("pearson_r"))
    strength = F.when(r > 0.3, "Strong").when(r > 0.1, "Moderate").otherwise("Weak")
    return (
        tall(summary, rows, "feature_name").join(F.broadcast(ends), "feature_name")
        .filter((F.col("n") > min_values) & F.col("varies"))
        .select("feature_name", "valid_mean", "invalid_mean", "pearson_r",
                correlation_p_value("pearson_r", F.col("n").cast("double")).alias("p_value"),
                strength.alias("separation"))
    )


def representatives(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """The first record of each case, carrying the name of the case that chose it."""
    df = enrich(df, spec)
    label, v, c = F.col(spec.label_col), number(df, spec.voltage), number(df, spec.current)
    bad = label == spec.positive
    # Case names and limits.
    cases = [
        ("Unusual Valid", (c > 95) & (label == spec.negative)),
        ("Quality Issue Invalid", F.col("data_quality_issue") & bad),
        ("Missing S4 Invalid", number(df, spec.sensors[-1]).isNull() & bad),
        ("Sensor Disagreement Invalid", (F.col("Sensor_Spread") > 50) & bad),
        ("Normal-Looking Invalid",
         v.between(18, 22) & c.between(50, 70) & ~F.col("missing_any") & bad),
    ]
    columns = [*_order(spec), spec.voltage, spec.current, spec.temperature, *spec.sensors,
               "Sensor_Spread", F.col("data_quality_issue").alias("DataQualityIssue"), spec.label_col]
    return _first_of_each(df, cases, _order(spec), columns, 1, "CaseCategory")


def relationships(df: DataFrame, spec: MeasurementSpec, min_values: int = 10) -> DataFrame:
    """Pearson and Spearman for every condition-sensor pair and every sensor pair.

    Ranks are taken among the rows complete for the pair. Each column is ordered once, whatever its number of pairs, and only the
    distinct values of a block of rows travel (``pair_correlations``).
    """
    sensors = spec.present(df, spec.sensors)
    operating = spec.present(df, (spec.current, spec.voltage, spec.temperature, spec.duration))
    pairs = [("Operating_vs_Sensor", a, b) for a in operating for b in sensors]
    pairs += [("Cross_Sensor_Pair", a, b) for a, b in pairs_of(sensors)]
    columns = list(dict.fromkeys([*operating, *sensors]))
    stats = pair_correlations(df, [number(df, c) for c in columns], [(columns.index(a), columns.index(b)) for _, a, b in pairs])

    names = df.sparkSession.createDataFrame(
        [(k, kind, a, b) for k, (kind, a, b) in enumerate(pairs)],
        "pair int, Category string, Variable_1 string, Variable_2 string")
    r, n = F.col("r"), F.col("n").cast("double")
    kind = (
        F.when(F.col("Category") == "Cross_Sensor_Pair",
               F.when(r > 0.7, "Strong Inter-Sensor Alignment").otherwise("Moderate Alignment"))
        .when(F.abs(r) > 0.6, "Strong Linear").when(F.abs(r) > 0.3, "Moderate").otherwise("Weak"))
    return stats.filter(F.col("n") >= min_values).join(F.broadcast(names), "pair").select(
        "Category", "Variable_1", "Variable_2", F.col("n").alias("Sample_Count"), r.alias("Pearson_r"),
        correlation_p_value(r, n).alias("Pearson_p"), F.col("rho").alias("Spearman_rho"),
        correlation_p_value("rho", n).alias("Spearman_p"), kind.alias("Relationship_Type"))


def residual_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "Residual" in c or c.startswith("p1_")]


def residual_statistics(df: DataFrame, spec: MeasurementSpec, columns=None, min_rows: int = 5) -> DataFrame:
    """Class moments, effect size, and the share of the positive class above the other's P90."""
    columns = residual_columns(df) if columns is None else list(columns)
    rows = {
        c: {"n_v": F.col(f"v_n_{k}"), "n_i": F.col(f"i_n_{k}"), "Valid_Mean": F.col(f"v_mean_{k}"),
            "Valid_Std": F.col(f"v_std_{k}"), "Invalid_Mean": F.col(f"i_mean_{k}"),
            "Invalid_Std": F.col(f"i_std_{k}"), "Cohens_D_EffectSize": cohens_d(k, 0.0)}
        for k, c in enumerate(columns)
    }
    stats = tall(_per_class(df, spec, columns), rows, "Residual_Feature").filter(
        (F.col("n_v") >= min_rows) & (F.col("n_i") >= min_rows))
    label = F.col(spec.label_col)
    classed = df.filter(label.isin(spec.positive, spec.negative)).withColumn(
        "__invalid", label == spec.positive)
    exprs = {c: number(df, c) for c in columns}
    q = quantile_columns(exact_quantiles(classed, exprs, [0.5, 0.9], by=["__invalid"]),
                         {0.5: "median", 0.9: "p90"}, by=["__invalid"])
    wide = q.groupBy("feature").agg(
        F.max(F.when(~F.col("__invalid"), F.col("median"))).alias("Valid_Median"),
        F.max(F.when(F.col("__invalid"), F.col("median"))).alias("Invalid_Median"),
        F.max(F.when(~F.col("__invalid"), F.col("p90"))).alias("p90"))
    long = melt(classed.filter("__invalid"), exprs)
    extreme = long.join(F.broadcast(wide.select("feature", "p90")), "feature").groupBy("feature").agg(
        F.avg((F.col("value") > F.col("p90")).cast("double")).alias("share"))
    table = stats.join(F.broadcast(wide), stats.Residual_Feature == wide.feature).drop("feature")
    return table.join(F.broadcast(extreme), table.Residual_Feature == extreme.feature).select(
        "Residual_Feature", "Valid_Mean", "Valid_Median", "Valid_Std", "Invalid_Mean", "Invalid_Median",
        "Invalid_Std", "Cohens_D_EffectSize", (F.col("share") * 100.0).alias("Invalid_Extreme_Residual_Rate_Pct"),
    ).orderBy(F.desc(F.abs("Cohens_D_EffectSize")), "Residual_Feature")


def sensor_reliability(residual_stats: DataFrame, performance: DataFrame) -> DataFrame:
    """Fit quality of each sensor's normal model next to the effect size of its absolute residual."""
    effect = residual_stats.select(F.col("Residual_Feature").alias("name"),
                                   F.col("Cohens_D_EffectSize").alias("AbsResidual_EffectSize"))
    r2 = F.col("R2_Score")
    rank = (F.when((r2 > 0.5) & (F.abs("AbsResidual_EffectSize") > 0.5), "High")
            .when(r2 > 0.2, "Moderate").otherwise("Low"))
    return performance.join(
        F.broadcast(effect), F.concat("Target_Sensor", F.lit("_AbsResidual")) == F.col("name"), "left",
    ).select(F.col("Target_Sensor").alias("Sensor"), r2.alias("Normal_Model_R2"),
             F.col("RMSE").alias("Normal_Model_RMSE"), "AbsResidual_EffectSize", rank.alias("Reliability_Rank"))


def unusual_residuals(df: DataFrame, spec: MeasurementSpec, limit: int = 5) -> DataFrame:
    label, v, c = F.col(spec.label_col), number(df, spec.voltage), number(df, spec.current)
    # Case names and limits.
    cases = [
        ("Unusual Heavy Load (Valid)", (c > 95) & (label == spec.negative)),
        ("Normal Parameters (Invalid)", v.between(15, 25) & c.between(50, 80) & (label == spec.positive)),
    ]
    columns = [*_order(spec), spec.current, F.col("p1_max_abs_residual").alias("Max_Abs_Residual"),
               F.col("p1_consistency_index").alias("Consistency_Index"), spec.label_col]
    return _first_of_each(df, cases, _order(spec), columns, limit, "Category")


def sensor_investigation(df: DataFrame, spec: MeasurementSpec, sensor: str | None = None) -> DataFrame:
    """Positive rate where one sensor is missing, and label correlations where it is present."""
    sensor = sensor or spec.sensors[-1]
    gone = number(df, sensor).isNull()
    y = encode_label(spec, trim=False).cast("double")
    sensors = spec.present(df, spec.sensors)
    summary = df.agg(
        F.count_if(gone).alias("missing"), F.avg(F.when(gone, y)).alias("rate"),
        *[correlation(F.when(~gone, F.coalesce(number(df, s), F.lit(0.0))), F.when(~gone, y)).alias(f"r_{s}")
          for s in sensors])
    rows = {f"{sensor} Missingness Signal": {
        "Records": F.col("missing"), "Value": F.coalesce(F.col("rate") * 100.0, F.lit(0.0))}}
    rows |= {f"{s} Correlation with Invalidity": {
        "Records": F.lit(None).cast("long"), "Value": F.col(f"r_{s}")} for s in sensors}
    return tall(summary, rows, "Analysis_Aspect")


def run_history(df: DataFrame, spec: MeasurementSpec) -> dict[str, DataFrame]:
    """The labelled-history analyses, all lazy."""
    associations = label_associations(df, spec)
    return {
        "class_balance": class_balance(df, spec), "class_statistics": class_statistics(df, spec),
        "associations": associations, "patterns": pattern_lift(df, spec),
        "regimes": unusual_regimes(df, spec),
        "shortlist": variable_shortlist(df, spec, associations=associations),
        "representatives": representatives(df, spec),
    }


def run_behaviour(train: DataFrame, spec: MeasurementSpec, test: DataFrame | None = None) -> dict:
    """Relationships, regimes, the fitted normal behaviour and what its residuals say."""
    model = fit_normal_behaviour(train, spec)
    residuals = model.transform(train)
    stats = residual_statistics(residuals, spec)
    return {
        "relationships": relationships(train, spec), "regime_frame": with_regimes(train, spec),
        "regimes": regime_summary(train, spec), "performance": model.performance(train),
        "residual_statistics": stats,
        "reliability": sensor_reliability(stats, model.performance(train)),
        "representatives": unusual_residuals(residuals, spec),
        "residuals_train": residuals,
        "residuals_test": model.transform(test) if test is not None else None,
        "model": model,
    }
