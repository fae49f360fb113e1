"""Expressions over the columns of one row. All skip NULLs unless they say otherwise."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; text that is no number and NaN become NULL."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.DoubleType):
        value = col
    elif isinstance(kind, T.StringType):
        value = col.try_cast("double")
    elif isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double")
    elif isinstance(kind, T.NumericType):
        value = col.cast("double")
    else:
        raise TypeError(f"column {name} of type {kind.simpleString()} is not numeric")
    return F.nanvl(value, F.lit(None).cast("double"))


def finite(value: Column) -> Column:
    """NULL for either infinity."""
    return F.when(F.abs(value) != INF, value)


def true_or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def any_of(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def total(columns) -> Column:
    return reduce(add, columns)


def count_true(flags) -> Column:
    return total([f.cast("int") for f in flags])


def count_present(values) -> Column:
    return total([v.isNotNull().cast("int") for v in values])


def mean_of(values) -> Column:
    n = count_present(values)
    return F.when(n > 0, total([F.coalesce(v, F.lit(0.0)) for v in values]) / n)


def median_of(values) -> Column:
    ordered = F.array_sort(F.array_compact(F.array(*values)))
    n = F.size(ordered)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def std_of(values) -> Column:
    """Sample standard deviation, NULL for fewer than two values."""
    n = count_present(values)
    mean = mean_of(values)
    squares = [F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values]
    return F.when(n > 1, F.sqrt(total(squares) / (n - 1)))


def spread_of(values) -> Column:
    return F.greatest(*values) - F.least(*values)


def joined_names(pairs, separator: str, empty: str | None = None) -> Column:
    """Join the names whose condition holds; ``pairs`` is a list of (condition, name)."""
    parts = [F.when(cond, name if isinstance(name, Column) else F.lit(name)) for cond, name in pairs]
    text = F.concat_ws(separator, *parts)
    return text if empty is None else F.when(text == "", F.lit(empty)).otherwise(text)


def pairs_of(names) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


def short_name(sensor: str) -> str:
    return sensor.replace("Sensor_", "")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation aggregate over rows with both values, NULL where one of them is constant.

    The built-in ``corr`` raises a division by zero there in ANSI mode.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
