"""Evaluation of detectors and classifiers; the positive class is 1.

Curves and areas come from counts per distinct score, never from a global sort of
the rows. Columns of a prediction table: ``y``, ``pred`` and ``score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions import metrics as M
from gaugesieve.functions.rowwise import number, true_or_false
from gaugesieve.functions.scale import sums_below
from gaugesieve.operators.audit import tall
from gaugesieve.operators.detectors import rule_detector
from gaugesieve.operators.features import regime_name
from gaugesieve.operators.flags import decode_label, encode_label, evidence_mask, hard_mask
from gaugesieve.operators.transforms import min_max
from gaugesieve.spec import MeasurementSpec

# The threshold grid, agreement groups, error types.
THRESHOLDS = tuple(round(0.10 + 0.05 * i, 2) for i in range(17))
AGREEMENT_GROUPS = {
    (1, 1): "Group 1 (Both Invalid/Anomalous)",
    (1, 0): "Group 2 (Supervised Invalid / Anomaly Normal)",
    (0, 1): "Group 3 (Supervised Valid / Anomaly Anomalous)",
    (0, 0): "Group 4 (Both Valid/Normal)",
}
ERROR_TYPES = ("False Positive (Valid -> Invalid)", "False Negative (Invalid -> Valid)",
               "Uncertain Prediction")
HYBRIDS = {
    "Supervised_only": (), "Supervised_plus_quality": ("quality",),
    "Supervised_plus_consistency": ("consistency",), "Supervised_plus_anomaly": ("anomaly",),
    "Supervised_plus_quality_consistency": ("quality", "consistency"),
    "Full_hybrid": ("quality", "consistency", "anomaly"),
}
# End of fixed values.


def long_predictions(df: DataFrame, methods, y: Column, keep=()) -> DataFrame:
    """One row per record and method from the ``<method>_pred`` and ``<method>_score`` columns."""
    entries = [F.struct(F.lit(m).alias("method"), F.col(f"{m}_pred").cast("int").alias("pred"),
                        F.col(f"{m}_score").cast("double").alias("score")) for m in methods]
    return df.select(*keep, y.alias("y"), F.inline(F.array(*entries)))


def confusion(df: DataFrame, by=()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in M.counts(F.col("y"), F.col("pred")).items()])


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Two rows, true class by predicted class, with row totals."""
    return tall(confusion(df), {
        "True Valid": {"Predicted_Valid": M.tn(), "Predicted_Invalid": M.fp(), "Row_Total": M.tn() + M.fp()},
        "True Invalid": {"Predicted_Valid": M.fn(), "Predicted_Invalid": M.tp(), "Row_Total": M.fn() + M.tp()}}, "Actual")


def _score_counts(df: DataFrame, by) -> DataFrame:
    """Per distinct score: rows and positives, those below, and the group totals."""
    by = list(by)
    table = sums_below(df.filter("score IS NOT NULL"), by, "score",
                       {"n": F.lit(1).cast("long"), "pos": F.col("y").cast("long")})
    totals = df.filter("score IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_n"), F.sum(F.col("y").cast("long")).alias("total_pos"))
    if by:
        return table.join(F.broadcast(totals), by)
    one = totals.agg(F.struct(F.max("total_n").alias("n"), F.max("total_pos").alias("pos"))).scalar()
    return table.withColumn("__t", one).select(
        "*", F.col("__t.n").alias("total_n"), F.col("__t.pos").alias("total_pos")).drop("__t")


def ranking_metrics(df: DataFrame, by=()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step form); NULL for a single class."""
    by = list(by)
    t = _score_counts(df, by)
    pos, n, neg = (F.col(c).cast("double") for c in ("pos", "n", "n"))
    neg = n - pos
    neg_below = (F.col("below_n") - F.col("below_pos")).cast("double")
    at_least_n = F.col("total_n") - F.col("below_n")
    at_least_pos = (F.col("total_pos") - F.col("below_pos")).cast("double")
    sums = t.groupBy(*by).agg(
        F.sum(pos * (neg_below + neg / 2)).alias("u"), F.sum(pos * at_least_pos / at_least_n).alias("ap"),
        F.max("total_pos").cast("double").alias("p"), F.max("total_n").cast("double").alias("t"))
    both = (F.col("p") > 0) & (F.col("p") < F.col("t"))
    return sums.select(
        *by, F.when(both, F.try_divide("u", F.col("p") * (F.col("t") - F.col("p")))).alias("ROC_AUC"),
        F.when(both, F.try_divide("ap", "p")).alias("PR_AUC"))


def roc_curve(df: DataFrame) -> DataFrame:
    """False and true positive rate when everything scoring at least ``threshold`` is flagged."""
    t = _score_counts(df, [])
    tp = (F.col("total_pos") - F.col("below_pos")).cast("double")
    fp = (F.col("total_n") - F.col("below_n")).cast("double") - tp
    return t.select(F.col("score").alias("threshold"),
                    F.try_divide(fp, F.col("total_n") - F.col("total_pos")).alias("fpr"),
                    F.try_divide(tp, F.col("total_pos")).alias("tpr"))


def precision_recall_curve(df: DataFrame) -> DataFrame:
    t = _score_counts(df, [])
    tp = (F.col("total_pos") - F.col("below_pos")).cast("double")
    return t.select(F.col("score").alias("threshold"),
                    (tp / (F.col("total_n") - F.col("below_n"))).alias("precision"),
                    F.try_divide(tp, F.col("total_pos")).alias("recall"))


def evaluate_detectors(long: DataFrame, by=("method",), ranking: bool = True, macro: bool = False) -> DataFrame:
    """One row per method: flagged rows, threshold metrics, areas, confusion counts."""
    by = list(by)
    table = confusion(long, by).withColumns({**M.flagged_share(), **M.metric_columns(macro)})
    if not ranking:
        return table
    return table.join(F.broadcast(ranking_metrics(long, by)), by, "left")


def evaluate_rule(df: DataFrame, spec: MeasurementSpec, rule: str) -> DataFrame:
    names = {"definite_issue": "Rule-based (Definite Quality Issue)",
             "definite_plus_duplicate": "Rule-based (Definite Issue + Duplicate Pair)"}
    hits = rule_detector(df, rule).select(encode_label(spec).alias("y"), F.col("rule_pred").alias("pred"))
    return confusion(hits).withColumns(M.metric_columns(macro=True)).select(
        F.lit(names[rule]).alias("Model"), "*")


def threshold_sweep(df: DataFrame, probability: str, y: Column, thresholds=THRESHOLDS) -> DataFrame:
    """Metrics at each threshold; fails on a NULL probability.

    Every row falls between two thresholds; the counts per gap, added up from the
    top, give all thresholds from one pass without multiplying rows.
    """
    thresholds = sorted(round(float(t), 2) for t in thresholds)
    p = number(df, probability)
    passed = sum(((p >= t).cast("int") for t in thresholds), F.lit(0))
    checked = F.when(p.isNull(), F.raise_error(F.lit("threshold sweep: missing probability"))).otherwise(passed)
    per_gap = df.groupBy(checked.cast("int").alias("gap")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y.cast("long")), F.lit(0)).alias("pos"))
    sums = []
    for i, _ in enumerate(thresholds):
        reached = F.col("gap") > i
        sums += [F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias(f"tp_{i}"),
                 F.sum(F.when(reached, F.col("n") - F.col("pos")).otherwise(0)).alias(f"fp_{i}")]
    totals = per_gap.agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"), *sums)
    table = tall(totals, {
        t: {"TP": F.col(f"tp_{i}"), "FP": F.col(f"fp_{i}"), "FN": F.col("positives") - F.col(f"tp_{i}"),
            "TN": F.col("rows") - F.col("positives") - F.col(f"fp_{i}")}
        for i, t in enumerate(thresholds)}, "Threshold")
    matrix = F.format_string("[[%d, %d], [%d, %d]]", M.tn(), M.fp(), M.fn(), M.tp())
    return table.withColumns({**M.flagged_share(), **M.metric_columns(), "Confusion_Matrix": matrix})


def select_threshold(sweep: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """The chosen row of a sweep, the best F1, and the candidates within ``tolerance`` of it."""
    best = sweep.agg(F.max("Invalid_F1")).scalar()
    near = sweep.withColumn("best_f1", best).filter(F.col("Invalid_F1") >= F.col("best_f1") - tolerance)
    rank = F.struct(-F.col("Invalid_Recall"), -F.col("Invalid_Precision"), F.col("FP"), F.col("Threshold"))
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("Threshold").alias("t"))))
    return near.agg(
        F.min_by("Threshold", rank).alias("selected_threshold"), F.max("best_f1").alias("best_f1"),
        F.count(F.lit(1)).alias("candidate_count"), F.concat_ws(", ", F.transform(
            ordered, lambda e: F.format_string("%.2f", e["t"]))).alias("candidate_thresholds"),
        F.min_by("Invalid_F1", rank).alias("Invalid_F1"), F.min_by("Invalid_Recall", rank).alias("Invalid_Recall"),
        F.min_by("Invalid_Precision", rank).alias("Invalid_Precision"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest F1, the lowest threshold among equals."""
    return sweep.orderBy(F.desc("Invalid_F1"), "Threshold").limit(1)


def fold_metrics(df: DataFrame, probability: str, y: Column, threshold: float, fold: str = "fold") -> DataFrame:
    pred = (number(df, probability) >= threshold).cast("int")
    scored = df.select(F.col(fold).alias("Fold"), y.alias("y"), pred.alias("pred"))
    sizes = M.tp() + M.tn() + M.fp() + M.fn()
    return confusion(scored, ["Fold"]).withColumns({"Fold_Size": sizes, **M.metric_columns()})


def fold_stability(per_fold: DataFrame) -> DataFrame:
    """Mean, population deviation and range of each metric over the folds."""
    names = ["Invalid_Precision", "Invalid_Recall", "Invalid_F1", "Balanced_Accuracy", "Accuracy"]
    return per_fold.unpivot([], names, "Metric", "value").groupBy("Metric").agg(
        F.avg("value").alias("Mean"), F.stddev_pop("value").alias("Std"),
        F.min("value").alias("Min"), F.max("value").alias("Max"))


def regime_performance(df: DataFrame, spec: MeasurementSpec, methods, min_rows: int = 5) -> DataFrame:
    """Precision, recall and F1 per operating regime and method; tiny regimes are left out."""
    regime = regime_name(df, spec, unknown=None)
    long = long_predictions(df.withColumn("Operating_Regime", regime),
                            methods, encode_label(spec, trim=False), ["Operating_Regime"])
    return confusion(long, ["Operating_Regime", "method"]).filter(
        M.tp() + M.tn() + M.fp() + M.fn() >= min_rows).select(
        "Operating_Regime", (M.tp() + M.tn() + M.fp() + M.fn()).alias("Regime_Record_Count"),
        (M.tp() + M.fn()).alias("Regime_Invalid_Count"), F.col("method").alias("Method"),
        M.precision().alias("Precision"), M.recall().alias("Recall"), M.f1().alias("F1_Score"))


def error_examples(df: DataFrame, spec: MeasurementSpec, methods, limit: int = 10) -> DataFrame:
    """The first false positives and false negatives of every method in id order."""
    keys = list(dict.fromkeys([spec.id_col, *spec.row_key]))
    wide = df.withColumn("Operating_Regime", regime_name(df, spec, unknown=None))
    extra = [c for c in ("p1_max_abs_residual",) if c in df.columns]
    long = long_predictions(wide, methods, encode_label(spec, trim=False), [
        *keys, "Operating_Regime", spec.current, spec.voltage, *extra, spec.label_col])
    wrong = long.filter(F.col("y") != F.col("pred")).withColumn(
        "Error_Type", F.when(F.col("pred") == 1, "FP").otherwise("FN"))
    order = W.partitionBy("method", "Error_Type").orderBy(*keys)
    # Spark keeps only the first rows of each partition before it shuffles for this filter.
    return wrong.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(
        F.col("method").alias("Method"), "Error_Type", *keys,
        F.when(F.col("Error_Type") == "FP", F.col("Operating_Regime")).alias("Operating_Regime"),
        spec.current, spec.voltage, *extra, spec.label_col)


def misclassifications(df: DataFrame, spec: MeasurementSpec, probability: str, threshold: float) -> DataFrame:
    """Every misclassified record with its error type and context flags."""
    pred = (number(df, probability) >= threshold).cast("int")
    y = encode_label(spec)

    def context(name, rule):
        return true_or_false(rule(number(df, name))) if name in df.columns else F.lit(False)

    return df.withColumns({
        "selected_prediction_binary": pred, "selected_prediction": decode_label(pred, spec),
        "operating_regime": regime_name(df, spec),
        "high_current_flag": context(spec.current, lambda v: v > 85),
        "high_voltage_flag": context(spec.voltage, lambda v: v > 25),
        "high_temperature_flag": context(spec.temperature, lambda v: v > 30),
        "long_duration_flag": context(spec.duration, lambda v: v >= 120),
        "high_residual_flag": context("p1_max_abs_residual", lambda v: v >= 10),
        "sensor_disagreement_flag": context("p1_sensor_disagreement_index", lambda v: v >= 1.5),
        "error_type": F.when((y == 0) & (pred == 1), "FP").when((y == 1) & (pred == 0), "FN"),
    }).filter(F.col("error_type").isNotNull())


def error_patterns(errors: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """Counts and rates of regimes and context conditions among false positives and negatives.

    An error type without errors gets one row saying so.
    """
    quality = F.col("data_quality_issue") if "data_quality_issue" in errors.columns else F.lit(False)
    entries = [
        ("Data Quality", "data_quality_issue", quality),
        ("Residual Severity", "p1_max_abs_residual >= 10", F.col("high_residual_flag")),
        ("Load", "Load_Current_A > 85", F.col("high_current_flag")),
        ("Voltage", "Applied_Voltage_kV > 25", F.col("high_voltage_flag")),
    ]
    regimes = errors.groupBy("error_type", F.col("operating_regime").alias("Pattern")).agg(
        F.count(F.lit(1)).alias("Count")).withColumn("Pattern_Category", F.lit("Operating Regime"))
    kinds = errors.sparkSession.createDataFrame([("FP",), ("FN",)], "error_type string")
    totals = kinds.join(
        errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("total"), *[
            F.count_if(c).alias(f"c_{i}") for i, (_, _, c) in enumerate(entries)]), "error_type", "left"
    ).na.fill(0)
    listed = totals.select("error_type", "total", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("Pattern_Category"), F.lit(name).alias("Pattern"), F.col(f"c_{i}").alias("Count"))
        for i, (kind, name, _) in enumerate(entries)])))
    listed = listed.filter("total > 0 AND (Pattern_Category != 'Data Quality' OR Count > 0)")
    empty = totals.filter("total = 0").select(
        "error_type", "total", F.concat("error_type", F.lit(" Count")).alias("Pattern_Category"),
        F.lit("None").alias("Pattern"), F.lit(0).cast("long").alias("Count"))
    counted = regimes.join(F.broadcast(totals.select("error_type", "total")), "error_type")
    rows = listed.unionByName(empty).unionByName(counted.select(*listed.columns))
    return rows.select(F.col("error_type").alias("Error_Type"), "Pattern_Category", "Pattern", "Count",
                       M.ratio(F.col("Count") * 100.0, F.col("total")).alias("Rate_Pct"))


def uncertain_or_wrong(df: DataFrame, y: Column, pred: Column, probability: Column,
                       low: float = 0.4, high: float = 0.6) -> DataFrame:
    """Records that are misclassified or whose probability lies in [low, high], with the kind."""
    kind = F.when(y < pred, ERROR_TYPES[0]).when(y > pred, ERROR_TYPES[1]).otherwise(ERROR_TYPES[2])
    return df.withColumn("Error_Type", kind).filter((y != pred) | probability.between(low, high))


def error_extract(predictions: DataFrame, context: DataFrame, spec: MeasurementSpec, columns) -> DataFrame:
    """Wrong predictions joined by key with context columns of the source table."""
    wrong = predictions.filter(F.col("y") != F.col("pred")).withColumn(
        "error_type", F.when(F.col("pred") == 1, "FP").otherwise("FN"))
    return wrong.join(context.select(*spec.row_key, *columns), list(spec.row_key))


def agreement_group(supervised: Column, anomaly: Column) -> Column:
    group = None
    for (s, a), name in AGREEMENT_GROUPS.items():
        test = (supervised == s) & (anomaly == a)
        group = F.when(test, name) if group is None else group.when(test, name)
    return group


def agreement(df: DataFrame, supervised: Column, anomaly: Column) -> DataFrame:
    """Sizes and shares of the four agreement groups."""
    counts = df.groupBy(agreement_group(supervised, anomaly).alias("Agreement_Group")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))))


def supervised_anomaly_table(supervised: DataFrame, anomaly: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """One row per record with both verdicts and their agreement group, joined by key."""
    both = supervised.join(anomaly, list(spec.row_key))
    return both.withColumn("Agreement_Group", agreement_group(F.col("supervised_flag"), F.col("anomaly_flag")))


def disagreement_cases(table: DataFrame, context: DataFrame, spec: MeasurementSpec, columns) -> DataFrame:
    """Records where classifier and anomaly detector differ, with raw features, joined by key."""
    differing = table.filter(F.col("Agreement_Group").isin(AGREEMENT_GROUPS[(1, 0)], AGREEMENT_GROUPS[(0, 1)]))
    return differing.join(context.select(*spec.row_key, *columns), list(spec.row_key))


def compare_hybrids(df: DataFrame, spec: MeasurementSpec, probability: str, anomaly: Column,
                    threshold: float = 0.40) -> DataFrame:
    """Metrics of the classifier alone and combined with quality, consistency and anomaly masks."""
    p = number(df, probability)
    masks = {"supervised": true_or_false(p >= threshold), "quality": hard_mask(df),
             "consistency": evidence_mask(df), "anomaly": true_or_false(anomaly)}
    base = df.select(encode_label(spec).alias("y"), p.alias("score"), *[m.alias(n) for n, m in masks.items()])

    def combined(used):
        hit = F.col("supervised")
        for name in used:
            hit = hit | F.col(name)
        return hit.cast("int")

    aggs = []
    for k, used in enumerate(HYBRIDS.values()):
        aggs += [c.alias(f"{n}_{k}") for n, c in M.counts(F.col("y"), combined(used)).items()]
    rows = {name: {n: F.col(f"{n}_{k}") for n in ("TP", "TN", "FP", "FN")} | {
        # Quality evidence counts as given for all but the classifier alone, as the published comparison has it.
        "Quality_Evidence": F.lit(bool(used)),
        **{f"{mask.capitalize()}_Evidence": F.lit(mask in used) for mask in ("consistency", "anomaly")}}
        for k, (name, used) in enumerate(HYBRIDS.items())}
    table = tall(base.agg(*aggs), rows, "Approach").withColumns(M.metric_columns())
    # The ranking score is the probability for every approach, so it is computed once.
    area = ranking_metrics(base).agg(F.struct(F.max("ROC_AUC").alias("roc"), F.max("PR_AUC").alias("pr"))).scalar()
    return table.withColumn("__area", area).select(
        "*", F.col("__area.roc").alias("ROC_AUC"), F.col("__area.pr").alias("PR_AUC")).drop("__area")


def hybrid_score(df: DataFrame, probability: str, anomaly: str, y: Column, threshold: float,
                 weights: tuple[float, float] = (0.7, 0.3), gain: float = 0.005) -> DataFrame:
    """F1 of the classifier and of its blend with the normalised anomaly score, and which to keep."""
    scaled = min_max(df, anomaly, "__anomaly")
    p = number(scaled, probability)
    blend = weights[0] * p + weights[1] * F.col("__anomaly")
    sums = scaled.select(y.alias("y"), p.alias("p"), blend.alias("blend")).agg(*[
        c.alias(f"{tag}_{n}") for tag, s in (("s", "p"), ("h", "blend"))
        for n, c in M.counts(F.col("y"), (F.col(s) >= threshold).cast("int")).items()])

    def f1_of(tag):
        return M.ratio(2 * F.col(f"{tag}_TP"), 2 * F.col(f"{tag}_TP") + F.col(f"{tag}_FP") + F.col(f"{tag}_FN"))

    return sums.select(f1_of("s").alias("supervised_f1"), f1_of("h").alias("hybrid_f1"),
                       (f1_of("h") > f1_of("s") + gain).alias("hybrid_retained"))


def oof_violations(df: DataFrame, id_columns, probability: str) -> DataFrame:
    """Counts of what an out-of-fold table must not contain: repeated ids, missing or impossible p."""
    p = number(df, probability)
    repeats = df.groupBy(*id_columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n")).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(p.isNull()).alias("missing_probability"),
                  F.count_if((p < 0) | (p > 1)).alias("out_of_range")).withColumn("repeated_id_rows", repeats)


def check_oof(df: DataFrame, spec: MeasurementSpec, probability: str = "oof_probability_invalid") -> None:
    """Raise on a table that is not one valid probability per record."""
    needed = {*spec.row_key, spec.label_col, probability, "fold"} - set(df.columns)
    if needed:
        raise ValueError(f"out-of-fold table lacks columns: {sorted(needed)}")
    bad = oof_violations(df, spec.row_key, probability).drop("rows").first().asDict()
    if any(bad.values()):
        raise ValueError(f"out-of-fold table is not valid: {bad}")
