"""Classification metrics as expressions over confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def counts(y: Column, pred: Column) -> dict[str, Column]:
    return {"TP": F.count_if((y == 1) & (pred == 1)), "TN": F.count_if((y == 0) & (pred == 0)),
            "FP": F.count_if((y == 0) & (pred == 1)), "FN": F.count_if((y == 1) & (pred == 0))}


def tp() -> Column:
    return F.col("TP")


def tn() -> Column:
    return F.col("TN")


def fp() -> Column:
    return F.col("FP")


def fn() -> Column:
    return F.col("FN")


def precision() -> Column:
    return ratio(tp(), tp() + fp())


def recall() -> Column:
    return ratio(tp(), tp() + fn())


def f1() -> Column:
    return ratio(2 * tp(), 2 * tp() + fp() + fn())


def macro_f1() -> Column:
    """Mean F1 of the classes that occur in truth or prediction."""
    positive = F.when(tp() + fp() + fn() > 0, f1())
    negative = F.when(tn() + fp() + fn() > 0, ratio(2 * tn(), 2 * tn() + fp() + fn()))
    seen = positive.isNotNull().cast("int") + negative.isNotNull().cast("int")
    return ratio(F.coalesce(positive, F.lit(0.0)) + F.coalesce(negative, F.lit(0.0)), seen)


def accuracy() -> Column:
    return ratio(tp() + tn(), tp() + tn() + fp() + fn())


def balanced_accuracy() -> Column:
    """Mean recall of the classes that occur in the truth."""
    sides = [F.try_divide(tp().cast("double"), tp() + fn()), F.try_divide(tn().cast("double"), tn() + fp())]
    seen = sides[0].isNotNull().cast("int") + sides[1].isNotNull().cast("int")
    return ratio(F.coalesce(sides[0], F.lit(0.0)) + F.coalesce(sides[1], F.lit(0.0)), seen)


def metric_columns(macro: bool = False) -> dict[str, Column]:
    columns = {"Invalid_Precision": precision(), "Invalid_Recall": recall(), "Invalid_F1": f1(),
               "Balanced_Accuracy": balanced_accuracy(), "Accuracy": accuracy()}
    return columns | ({"Macro_F1": macro_f1()} if macro else {})


def flagged_share() -> dict[str, Column]:
    return {"Num_Flagged": tp() + fp(), "Flag_Pct": ratio((tp() + fp()) * 100.0, tp() + tn() + fp() + fn())}
