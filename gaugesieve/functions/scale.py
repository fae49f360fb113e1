"""Building blocks that keep a hot key, a hot value or a global order off a single task."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import scratch, sized_broadcast, stored

CUTS = 4096
MAX_BINS = 1 << 17
GATHERED = 1024
SPANS_AT_ONCE = 200
SAMPLED = 20_000
FILTERED_SPANS = 200
COLUMNS_AT_ONCE = 6
MAX_HOT_KEYS = 1000
BUCKET_DIGITS = 3  # hexadecimal digits of a digest that tell its bucket
CROWDED = 100_000


def hot_keys(df: DataFrame, keys, fraction: float = 0.001, seed: int = 17) -> DataFrame:
    """At most ``MAX_HOT_KEYS`` key combinations, the most repeated ones of a row sample.

    Each of them was met on two different rows, so it does repeat in ``df``. A key
    that is left out is merely handled by the ordinary path.
    """
    return (
        df.select(*keys)
        .sample(fraction, seed)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__hits"))
        .filter("__hits > 1")
        .orderBy(F.desc("__hits"))
        .limit(MAX_HOT_KEYS)
        .drop("__hits")
    )


def mark_hot(df: DataFrame, hot: DataFrame, keys, out: str) -> DataFrame:
    """Add the boolean ``out``: the row's key combination is in ``hot`` (NULL equals NULL)."""
    side = hot.select(*[F.col(f"`{k}`").alias(f"__hot_{i}") for i, k in enumerate(keys)],
                      F.lit(True).alias("__is_hot"))
    condition = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"__hot_{i}"))
                              for i, k in enumerate(keys)])
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.join(F.broadcast(side), condition, "left").select(
        *kept, F.coalesce("__is_hot", F.lit(False)).alias(out))


def spread_salt(df: DataFrame, salts: int, *extra) -> Column:
    """A salt from the row's content and partition number: stable on retry, and it also parts equal rows."""
    content = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], *extra), F.lit(salts))
    return F.pmod(content + F.spark_partition_id(), F.lit(salts))


def melt(df: DataFrame, columns: dict[str, Column], keep=(), name: str = "feature",
         value: str = "value") -> DataFrame:
    """Long form (``keep`` columns, name, value) of the given expressions, NULL values dropped."""
    wide = df.select(*keep, *[c.alias(n) for n, c in columns.items()])
    return wide.unpivot(list(keep), list(columns), name, value).filter(F.col(value).isNotNull())


@dataclass
class _Span:
    """The values of one unit whose keys lie in a closed interval, how many lie below and in it, and the wanted ranks there."""

    unit: int
    low: int
    high: int
    before: int = 0
    inside: int | None = None
    ranks: list[int] | None = None
    of: int = 0  # how many values the unit has

    def shift(self, cuts: int) -> int:
        """The width of a bin, as a power of two, that makes at most ``cuts`` of the interval."""
        return next(s for s in range(65) if (self.high - self.low) >> s < cuts)


def _key_of(value: float) -> int:
    """A whole number that orders the doubles: their bits, turned round below zero."""
    bits = struct.unpack("<q", struct.pack("<d", value))[0]
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def _value_of(key: int) -> float:
    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF))[0]


# The keys of all values, and the bins that stand for a unit's number of values and for those below an interval.
WHOLE = _key_of(float("-inf")), _key_of(float("inf"))
TOTAL, BELOW = -2, -1


def order_statistics(df: DataFrame, columns: list[Column], wanted, units=None, part: Column | None = None) -> list[tuple[int, dict[int, float]]]:
    """For each unit the number of its values and those at the ranks ``wanted(number)``; ranks count from 0, NaN as infinity.

    A unit is (place in ``columns``, None), or (place, (number, same)): the rows whose ``part`` is that number, or those where it
    is not. Without ``units`` each column is one. All units are searched at once. In a large table a sample of the rows tells an interval that very likely
    holds a wanted rank, and the first round counts the values below it and those in it; a rank that is not there is searched among all values. Every round counts the values between the
    ends of each interval that holds a wanted rank, in up to CUTS bins of equal width in the bits of the doubles, with the smallest and largest
    value of each bin; where these are equal, or at most GATHERED values are left, the rank is found. The bits are 64 whatever the
    values, so a few rounds do for any distribution, and the counts of a task are as many as the bins, whatever its rows. The stored
    values are deleted when the ranks are found.
    """
    with scratch(df.sparkSession):
        return _order_statistics(df, columns, wanted, units, part)


def _order_statistics(df: DataFrame, columns: list[Column], wanted, units, part: Column | None) -> list[tuple[int, dict[int, float]]]:
    units = [(i, None) for i in range(len(columns))] if units is None else list(units)
    # The values are stored once, each as a narrow column, whatever the number of units that read it.
    table = stored(df.select(*[v.cast("double").alias(f"u{i}") for i, v in enumerate(columns)],
                             *([] if part is None else [part.cast("int").alias("part")])), "values")
    found = [(0, {}) for _ in units]

    def settle(span: _Span, bins) -> list[_Span]:
        """Note the ranks that the bins of a span tell; the bins that hold the others."""
        upto, left = span.before, []
        for low, high, size in bins:
            ranks = [r for r in span.ranks if upto <= r < upto + size]
            ends = {upto: low, upto + size - 1: high}
            found[span.unit][1].update({r: _value_of(ends.get(r, low)) for r in ranks if r in ends or low == high})
            if more := [r for r in ranks if r not in ends and low != high]:
                left.append(_Span(span.unit, low, high, upto, size, more, found[span.unit][0]))
            upto += size
        return left

    rows = table.count()
    pending, spans = [], _likely(table, units, wanted, SAMPLED / rows) if rows > 2 * SAMPLED else []
    for unit, group in groupby(_sieved(table, units, spans, max(2, min(CUTS, MAX_BINS // max(1, len(spans))))), key=lambda e: e[0].unit):
        lost = None
        for span, n, below, bins in group:
            if lost is None:
                found[unit] = (n, {})
                lost = set(wanted(n)) if n else set()
            span.before, span.inside = below, sum(size for *_, size in bins)
            span.ranks = sorted(r for r in lost if below <= r < below + span.inside)
            lost -= set(span.ranks)
            pending += settle(span, bins)
        if lost:
            pending.append(_Span(unit, *WHOLE, ranks=sorted(lost)))
    asked = {s.unit for s in spans}
    pending += [_Span(u, *WHOLE) for u in range(len(units)) if u not in asked]
    while pending:
        few = [s for s in pending if s.inside is not None and s.inside <= GATHERED]
        many = [s for s in pending if s.inside is None or s.inside > GATHERED]
        for span, bins in _counted(table, units, few, None):
            upto = span.before
            for low, _, size in bins:
                found[span.unit][1].update({r: _value_of(low) for r in span.ranks if upto <= r < upto + size})
                upto += size
        pending = []
        for span, bins in _counted(table, units, many, max(2, min(CUTS, MAX_BINS // max(1, len(many))))):
            if span.ranks is None:
                n = sum(size for *_, size in bins)
                found[span.unit] = (n, {})
                span.ranks = sorted(set(wanted(n))) if n else []
            pending += settle(span, bins)
    return found


def _likely(table: DataFrame, units, wanted, fraction: float) -> list[_Span]:
    """For each unit disjoint intervals between values of a sample, five deviations of its ranks around the wanted ones."""
    sample = table.sample(fraction, 17).toArrow()
    part = sample.column("part").to_numpy() if "part" in sample.column_names else None
    keys, out = {}, []
    for u, (column, test) in enumerate(units):
        if column not in keys:
            values = sample.column(f"u{column}").combine_chunks()
            there = values.is_valid().to_numpy(zero_copy_only=False)
            keys[column] = there, _plain(values)
        there, x = keys[column]
        if test is not None:
            number, same = test
            x = x[(part[there] == number) == same]
        x, m = np.sort(x), len(x)
        spans = []
        for r in sorted(set(wanted(m))) if m else [0]:
            share = r / max(1, m - 1)
            slack = 5 * math.sqrt(m * share * (1 - share)) + 5
            low, high = math.floor(r - slack), math.ceil(r + slack)
            low, high = WHOLE[0] if low < 0 else _key_of(x[low]), WHOLE[1] if high >= m else _key_of(x[high])
            if spans and low <= spans[-1].high:
                spans[-1].high = max(high, spans[-1].high)
            else:
                spans.append(_Span(u, low, high))
        out += spans
    return out


def _near(units, spans: list[_Span]) -> dict[int, list[list[int]]] | None:
    """For each column intervals of keys that hold the spans; None if a span may hold many of the values or there are many spans."""
    if any(s.inside is None or s.inside > s.of / 20 for s in spans):
        return None
    ends = {}
    for column, group in groupby(sorted(spans, key=lambda s: (units[s.unit][0], s.low)), key=lambda s: units[s.unit][0]):
        ends[column], last = [], None
        for s in group:  # the same quantile of several folds makes one interval
            share = s.before / s.of
            if last is not None and (s.low <= ends[column][-1][1] or abs(share - last) < 0.002):
                ends[column][-1][1] = max(ends[column][-1][1], s.high)
            else:
                ends[column].append([s.low, s.high])
            last = share
    return ends if sum(map(len, ends.values())) <= FILTERED_SPANS else None


def _inside(column: int, ends: list[list[int]]) -> Column:
    tests = []
    for low, high in ends:
        value, most = F.col(f"u{column}"), _value_of(high)
        least = value >= F.lit(_value_of(low))
        tests.append(least if most == math.inf else least & (value <= F.lit(most)))  # NaN counts as infinity
    return reduce(or_, tests)


def _plan(units, part, cuts: int | None):
    """Per unit: column, rows, number of its first span, and the ends and bin widths of its spans."""
    plan = []
    for unit, group in groupby(enumerate(part), key=lambda e: e[1].unit):
        numbers, listed = zip(*group)
        plan.append((*units[unit], numbers[0], np.array([s.low for s in listed], np.int64), np.array([s.high for s in listed], np.int64),
                     np.array([s.shift(cuts) if cuts else 0 for s in listed], np.uint64)))
    return plan


def _bins_of(table: DataFrame, plan, binning, cuts: int | None, near=None) -> dict[int, list]:
    """What the partitions have counted, added up: for each span (bin, smallest key, largest key, number) in the order of the bins.

    A few columns are scanned at a time, without the others and, where ``near`` tells intervals, only the rows with a value in these.
    """
    listed, parts = sorted({column for column, *_ in plan}), []
    for at in range(0, len(listed), COLUMNS_AT_ONCE):
        some = listed[at:at + COLUMNS_AT_ONCE]
        rows = table.select(*[f"u{c}" for c in some], *[c for c in table.columns if c == "part"])
        if near is not None:
            rows = rows.filter(reduce(or_, [_inside(c, near[c]) for c in some]))
        parts.append(rows.mapInArrow(binning([p for p in plan if p[0] in some], cuts), "span int, bin long, n long, low long, high long"))
    bins = reduce(DataFrame.union, parts).groupBy("span", "bin").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by([("span", "ascending"), ("bin", "ascending")])
    listed = list(zip(*[bins.column(c).to_pylist() for c in ("span", "bin", "low", "high", "n")]))
    return {k: [b[1:] for b in group] for k, group in groupby(listed, key=lambda b: b[0])}


def _counted(table: DataFrame, units, spans: list[_Span], cuts: int | None):
    """Each interval with (smallest key, largest key, number) of its bins in their order; without ``cuts`` every value is a bin."""
    near = _near(units, spans)
    at_once = len(spans) if cuts else SPANS_AT_ONCE
    for at in range(0, len(spans), max(1, at_once)):
        part = sorted(spans[at:at + at_once], key=lambda s: (s.unit, s.low))
        known = _bins_of(table, _plan(units, part, cuts), _binning, cuts, near)
        yield from ((s, [b[1:] for b in known.get(k, [])]) for k, s in enumerate(part))


def _sieved(table: DataFrame, units, spans: list[_Span], cuts: int):
    """Each interval with the number of its unit's values, that of those below it, and its bins as ``_counted`` has them; in the order of the units."""
    if not spans:
        return
    part = sorted(spans, key=lambda s: (s.unit, s.low))
    known = _bins_of(table, _plan(units, part, cuts), _sieving, cuts)
    for k, span in enumerate(part):
        bins = known.get(k, [])
        numbers = {b: n for b, _, _, n in bins if b < 0}
        yield span, numbers.get(TOTAL, 0), numbers.get(BELOW, 0), [b[1:] for b in bins if b[0] >= 0]


def _plain(values) -> np.ndarray:
    """The values that are there, with one zero only and NaN as infinity."""
    x = values.drop_null().to_numpy(zero_copy_only=False) + 0.0
    gaps = np.isnan(x)
    if gaps.any():
        x[gaps] = np.inf
    return x


def _keys(x: np.ndarray) -> np.ndarray:
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ 0x7FFFFFFFFFFFFFFF, bits)


def _rows_of(batch, test, there: np.ndarray, parts: dict) -> np.ndarray:
    """Which of the values that are there belong to the rows that ``test`` asks for."""
    if test not in parts:
        number, same = test
        parts[test] = (batch.column("part").to_numpy(zero_copy_only=False) == number) == same
    return parts[test][there]


def _filled_bins(sums, slot: np.ndarray, key: np.ndarray) -> None:
    count, least, most = sums
    np.add.at(count, slot, 1)
    np.minimum.at(least, slot, key)
    np.maximum.at(most, slot, key)


def _empty_bins(n: int):
    return np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)


def _bin_rows(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(columns[0]).astype(np.int32)), *[pa.array(np.asarray(c, np.int64)) for c in columns[1:]]],
                                      ["span", "bin", "n", "low", "high"])


def _sieving(plan, cuts: int):
    """Counts the values of a partition per unit, below each of its intervals and per bin in it; only values in an interval become keys."""
    def run(batches):
        sums = [_empty_bins(len(low) * cuts) for *_, low, _, _ in plan]
        total, below = np.zeros(len(plan), np.int64), [np.zeros(len(low), np.int64) for *_, low, _, _ in plan]
        ends = [[(_value_of(int(a)), _value_of(int(b))) for a, b in zip(low, high)] for *_, low, high, _ in plan]
        for batch in batches:
            values, parts = {}, {}
            for u, (column, test, _, low, _, shift) in enumerate(plan):
                if column not in values:
                    one = batch.column(f"u{column}")
                    values[column] = one.is_valid().to_numpy(zero_copy_only=False), _plain(one)
                there, x = values[column]
                if test is not None:
                    x = x[_rows_of(batch, test, there, parts)]
                total[u] += len(x)
                for i, (least, most) in enumerate(ends[u]):
                    reached = x >= least
                    below[u][i] += len(x) - np.count_nonzero(reached)
                    key = _keys(x[reached & (x <= most)])
                    _filled_bins(sums[u], i * cuts + ((key - low[i]).view(np.uint64) >> shift[i]).astype(np.int64), key)
        for u, (*_, first, low, _, _) in enumerate(plan):
            spans, nothing = first + np.arange(len(low)), np.zeros(len(low), np.int64)
            yield _bin_rows((spans, nothing + TOTAL, nothing + total[u], nothing, nothing))
            yield _bin_rows((spans, nothing + BELOW, below[u], nothing, nothing))
            slot = np.flatnonzero(sums[u][0])
            if len(slot):
                yield _bin_rows((slot // cuts + first, slot % cuts, *[s[slot] for s in sums[u]]))
    return run


def _binning(plan, cuts: int | None):
    """Counts the keys of a partition per interval and bin; without ``cuts`` the key itself stands for the bin."""
    def run(batches):
        sums = [None if cuts is None else _empty_bins(len(low) * cuts) for *_, low, _, _ in plan]
        seen = [[] for _ in plan]
        for batch in batches:
            keys, parts = {}, {}
            for u, (column, test, _, low, high, shift) in enumerate(plan):
                if column not in keys:
                    values = batch.column(f"u{column}")
                    keys[column] = values.is_valid().to_numpy(zero_copy_only=False), _keys(_plain(values))
                there, key = keys[column]
                if test is not None:
                    key = key[_rows_of(batch, test, there, parts)]
                at = np.searchsorted(low, key, side="right") - 1
                inside = (at >= 0) & (key <= high[at])
                key, at = key[inside], at[inside]
                if cuts is None:
                    seen[u].append((at, key))
                else:
                    slot = at * cuts + ((key.view(np.uint64) - low.view(np.uint64)[at]) >> shift[at]).astype(np.int64)
                    _filled_bins(sums[u], slot, key)
        for u, (*_, first, low, _, _) in enumerate(plan):
            if cuts is None:
                at, key = (np.concatenate([e[i] for e in seen[u]] or [np.zeros(0, np.int64)]) for i in range(2))
                columns = at, key, np.ones(len(key), np.int64), key, key
            else:
                slot = np.flatnonzero(sums[u][0])
                columns = slot // cuts, slot % cuts, *[s[slot] for s in sums[u]]
            if len(columns[0]):
                yield _bin_rows((columns[0] + first, *columns[1:]))
    return run


def _between(values: dict[int, float], n: int, prob: float) -> float:
    """Linear interpolation between the two ranks around ``prob``."""
    position = (n - 1) * prob
    low, high = values[math.floor(position)], values[math.ceil(position)]
    return low if low == high or position == math.floor(position) else low + (high - low) * (position - math.floor(position))


def _both_ranks(probs):
    return lambda n: [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs, by=()) -> DataFrame:
    """Exact, linearly interpolated quantiles: (``by``, feature, prob, quantile).

    The search runs when this is called and the result has one row per group, feature and probability. ``by`` columns
    must come from a small domain such as a class label. Features without values have no rows.
    """
    by, probs = list(by), [float(p) for p in probs]
    groups = [tuple(r) for r in df.select(*by).distinct().collect()] if by else [()]
    part = None
    for g, group in enumerate(groups if by else []):
        same = reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, group)])
        part = F.when(same, g) if part is None else part.when(same, g)
    units, names = [], []
    for g, group in enumerate(groups):
        for i, name in enumerate(columns):
            units.append((i, (g, True) if by else None))
            names.append((*group, name))
    rows = []
    found = order_statistics(df, list(columns.values()), _both_ranks(probs), units, part) if units else []
    for name, (n, values) in zip(names, found):
        rows += [(*name, p, _between(values, n, p)) for p in probs] if n else []
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("feature", T.StringType()),
                           T.StructField("prob", T.DoubleType()), T.StructField("quantile", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)


def quantile_columns(quantiles: DataFrame, names: dict[float, str], by=()) -> DataFrame:
    """One row per group and feature with one column per wanted probability."""
    picks = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n)
             for p, n in names.items()]
    return quantiles.groupBy(*by, "feature").agg(*picks)


def collect_quantiles(df: DataFrame, columns: dict[str, Column], probs) -> dict[str, dict[float, float]]:
    """Exact quantiles as a dictionary on the driver: one number per column and probability."""
    probs = [float(p) for p in probs]
    found = order_statistics(df, list(columns.values()), _both_ranks(probs)) if columns else []
    return {name: {p: _between(values, n, p) for p in probs} if n else {} for name, (n, values) in zip(columns, found)}


def quantiles_outside_folds(df: DataFrame, columns: dict[str, Column], prob: float, fold: str, k: int) -> list[dict[str, float | None]]:
    """For each fold 1..k an exact quantile of every column over the rows of the other folds; None where these have no value."""
    if not columns:
        return [{} for _ in range(k)]
    units = [(c, (i, False)) for i in range(1, k + 1) for c in range(len(columns))]
    found = order_statistics(df, list(columns.values()), _both_ranks([prob]), units, F.col(fold))
    medians = [_between(values, n, prob) if n else None for n, values in found]
    return [dict(zip(columns, medians[i * len(columns):(i + 1) * len(columns)])) for i in range(k)]


def sums_below(df: DataFrame, by, value: str, sums: dict[str, Column]) -> DataFrame:
    """Per distinct ``value``: each sum, and ``below_<name>``, its total over all smaller values; null values are left out.

    Rows are counted per value first, so a hot value is one row. The values are dealt into ranges of equal numbers of
    values by Spark's range partitioning, whose number of cuts is that of the partitions whatever the number of rows or groups; each
    partition sums in one ordered pass, and the totals of a group's partitions supply the offsets. The sums must be whole numbers.
    The work runs when this is called and its result is stored.
    """
    by, names = list(by), list(sums)
    per_value = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])
    ordered = per_value.repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    fields = [*per_value.schema.fields, *[T.StructField(f"below_{n}", T.LongType()) for n in names], T.StructField("__part", T.IntegerType())]
    local = stored(ordered.mapInArrow(_running(len(by), names), T.StructType(fields)), "ranks")
    if not by:
        local = local.withColumn("__all", F.lit(1))
    group = by or ["__all"]
    totals = local.groupBy(*group, "__part").agg(*[F.sum(n).alias(f"__sum_{n}") for n in names])
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(totals.select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(group)], F.col("__part").alias("__of"), *[
        F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in names]), "offsets")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate(group)], F.col("__part") == F.col("__of"))
    return local.join(sized_broadcast(offsets), same).select(
        *by, value, *names, *[(F.col(f"__off_{n}") + F.col(f"below_{n}")).alias(f"below_{n}") for n in names])


def _running(keys: int, names: list[str]):
    """Running sums over a sorted partition; they start anew with every combination of the first ``keys`` columns."""
    def run(batches):
        part = TaskContext.get().partitionId()
        last, carried = None, [0] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            coded = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in range(keys)]
            turns = np.zeros(n, bool)
            for c in coded:
                turns[1:] |= c[1:] != c[:-1]
            turns[0] = tuple(batch.column(i)[0].as_py() for i in range(keys)) != last
            starts = np.flatnonzero(turns).tolist()
            below = []
            for k in range(len(names)):
                own = batch.column(keys + 1 + k).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(own) - own
                # Subtract what was summed before a group's first row; before the first start the carried sum goes on.
                base = np.zeros(n, np.int64)
                for s, e in zip(starts, [*starts[1:], n]):
                    base[s:e] = upto[s]
                found = upto - base
                found[:starts[0] if starts else n] += carried[k]
                carried[k] = int(found[-1] + own[-1])
                below.append(pa.array(found))
            last = tuple(batch.column(i)[n - 1].as_py() for i in range(keys))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *below, pa.array(np.full(n, part, np.int32))],
                [*batch.schema.names, *[f"below_{n}" for n in names], "__part"])
    return run


def row_digest(keys, seed=None) -> Column:
    """MD5 of the key columns, a stable pseudo-random order of the rows."""
    parts = [F.col(f"`{k}`").cast("string") for k in keys]
    return F.md5(F.concat_ws("-", *parts, *([F.lit(str(seed))] if seed is not None else [])))


def rank_by_digest(df: DataFrame, by, keys, seed, out: str) -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY row_digest(keys, seed))`` without one task per group; rows of one
    digest share the number of the first.

    The rows of a group are dealt into buckets by the beginnings of their digests and counted per bucket when this is called; a row's rank is
    its rank in its bucket and the number of rows in the buckets before. So each row moves once, with 16 bytes of digest. Digests
    are spread evenly, but where a key repeats very often its bucket is crowded: of such buckets only the digests are ranked, counted
    per value (``sums_below``), and looked up by the rows.
    """
    by, columns = list(by), df.columns
    groups = [f"__b{i}" for i in range(len(by))]
    text = df.withColumn("__text", row_digest(keys, seed))
    dealt = text.withColumns({"__digest": F.unhex("__text"), "__bucket": F.conv(F.substring("__text", 1, BUCKET_DIGITS), 16, 10).cast("int")}).drop("__text")
    named = [F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)]
    counts = dealt.groupBy(*named, F.col("__bucket").alias("__in")).agg(F.count(F.lit(1)).alias("__n"))
    group = groups or [F.lit(1)]
    earlier = W.partitionBy(*group).orderBy("__in").rowsBetween(W.unboundedPreceding, -1)
    mean = F.sum("__n").over(W.partitionBy(*group)) / F.lit(16 ** BUCKET_DIGITS)
    offsets = sized_broadcast(stored(counts.select(*groups, "__in", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), (
        (F.col("__n") > CROWDED) & (F.col("__n") > 8 * mean)).alias("__crowded")), "offsets"))
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(g)) for c, g in zip(by, groups)], F.col("__bucket") == F.col("__in"))
    kept = [F.col(f"`{c}`") for c in columns]

    def spread(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__rank", F.rank().over(W.partitionBy(*kept_by, "__bucket").orderBy("__digest")).cast("long"))

    kept_by = [F.col(f"`{c}`") for c in by]
    if offsets.filter("__crowded").isEmpty():
        return spread(dealt).join(offsets, same).select(*kept, (F.col("__before") + F.col("__rank")).alias(out))
    placed = dealt.join(offsets, same)
    ranked = spread(placed.filter("NOT __crowded").drop(*groups)).select(*kept, (F.col("__before") + F.col("__rank")).alias(out))
    crowd = placed.filter("__crowded").drop("__bucket")
    ranks = sums_below(crowd, [*groups, "__in"], "__digest", {"n": F.lit(1).cast("long")})
    ranks = sized_broadcast(stored(ranks.select(*[F.col(g).alias(f"{g}_") for g in groups], F.col("__digest").alias("__of"), "below_n"), "ranks"))
    found = reduce(and_, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups], F.col("__digest") == F.col("__of"))
    return ranked.unionByName(crowd.join(ranks, found).select(*kept, (F.col("__before") + F.col("below_n") + 1).alias(out)))


def lookup_by_key(left: DataFrame, table: DataFrame, keys, weight: str, salts: int = 64) -> DataFrame:
    """Inner join with a table of unique keys whose ``weight`` is the number of matching left rows.

    The heaviest ``MAX_HOT_KEYS`` keys are known from the table itself; their left
    rows are spread over ``salts`` partitions and the matching table rows repeated.
    """
    keys = list(keys)
    hot = table.orderBy(F.desc(weight)).limit(MAX_HOT_KEYS).select(*keys)
    marked = mark_hot(left, hot, keys, "__hot")
    salted = marked.withColumn(
        "__salt", F.when(F.col("__hot"), spread_salt(left, salts)).otherwise(F.lit(0)).cast("int"))
    repeats = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    side = mark_hot(table, hot, keys, "__hot").withColumn("__salt", F.explode(repeats)).drop("__hot")
    return salted.drop("__hot").join(side, [*keys, "__salt"]).drop("__salt")


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan that has fewer partitions than the cluster has cores.

    A table of many splits, the ordinary case, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
