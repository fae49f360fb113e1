"""Validated joins of predictions and the checks a submission must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.storage import stored
from gaugesieve.sources.io import read_result, write_table
from gaugesieve.spec import MeasurementSpec


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """One row: rows without a key and rows whose key is not unique."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("missing_ids"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_ids"))


def id_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that only one side has, and which side; empty when the sets are equal.

    Both sides are counted per key before they meet, so a hot key is one row.
    """
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.filter("l <> r").select(key, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def submission_violations(predictions: DataFrame, expected: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """One row of violation counts; a valid submission has zeros throughout."""
    key, label = spec.row_key[0], F.col(spec.label_col)
    keys = key_violations(predictions, key).agg(F.struct(
        F.max("missing_ids").alias("missing"), F.max("repeated_ids").alias("repeated"))).scalar()
    unmatched = id_set_difference(predictions, expected, key).agg(F.count(F.lit(1))).scalar()
    rows = expected.agg(F.count(F.lit(1))).scalar()
    counts = predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(label.isNull()).alias("missing_labels"),
        F.count_if(~label.isin(spec.positive, spec.negative)).alias("unknown_labels"))
    return counts.withColumn("keys", keys).select(
        (F.col("rows") - rows).alias("row_difference"), F.col("keys.missing").alias("missing_ids"),
        F.col("keys.repeated").alias("repeated_ids"), unmatched.alias("unmatched_ids"), "missing_labels", "unknown_labels")


def check_submission(predictions: DataFrame, expected: DataFrame, spec: MeasurementSpec) -> None:
    """Raise unless the table is exactly one known label for each expected key."""
    wanted = [spec.row_key[0], spec.label_col]
    if predictions.columns != wanted:
        raise ValueError(f"expected exactly the columns {wanted}, got {predictions.columns}")
    bad = submission_violations(predictions, expected, spec).first().asDict()
    if any(bad.values()):
        raise ValueError(f"submission is not valid: {bad}")


def build_submission(detector, test: DataFrame, spec: MeasurementSpec, path: str | None = None,
                     fmt: str = "csv") -> DataFrame:
    """Predict with a fitted detector, validate, and publish to ``path`` if one is given.

    The predictions are staged first, as files in the shared folder, and what is checked, written and returned are those files:
    a detector that is not quite repeatable cannot publish other rows than were checked.
    """
    predictions = stored(detector.predict(test).select(spec.row_key[0], spec.label_col), "staged")
    check_submission(predictions, test, spec)
    if path is not None:
        publish(predictions, path, fmt)
    return predictions


def publish(staged: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Write staged rows to ``path``, read them back and raise if a row got lost or changed; the published rows."""
    write_table(staged, path, fmt)
    published = read_result(staged.sparkSession, path, staged.schema, fmt)

    def digest(df: DataFrame):
        rows = F.xxhash64(*[F.col(f"`{c}`") for c in staged.columns])
        return df.agg(F.count(F.lit(1)), F.bit_xor(rows), F.sum(F.shiftright(rows, 20))).first()

    if digest(staged) != digest(published):
        raise ValueError(f"what {path} holds is not what was checked")
    return published


def final_submission(expected: DataFrame, values: DataFrame, labels: DataFrame, spec: MeasurementSpec,
                     value_name: str = "Predicted_Reference_Parameter") -> DataFrame:
    """Expected keys joined one to one with predicted values and labels, columns in fixed order.

    The value column may also carry the target's own name. Every input is checked first.
    """
    key = spec.row_key[0]
    if value_name not in values.columns:
        if spec.target_col not in values.columns:
            raise ValueError(f"the value table needs {value_name} or {spec.target_col}")
        values = values.withColumnRenamed(spec.target_col, value_name)
    if set(values.columns) != {key, value_name}:
        raise ValueError(f"the value table must hold only {key} and its prediction")
    check_submission(labels.select(key, spec.label_col), expected, spec)
    bad = key_violations(values, key).first().asDict()
    bad["missing_values"] = values.filter(F.col(value_name).isNull()).count()
    bad["unmatched_ids"] = id_set_difference(values, expected, key).count()
    if any(bad.values()):
        raise ValueError(f"the value table is not valid: {bad}")
    return expected.select(key).join(values, key).join(labels.select(key, spec.label_col), key).select(
        key, value_name, spec.label_col)
