"""Rank statistics of many columns at once: rows are taken in blocks, and of a column only the distinct values of a block travel.

A column is parted into ranges by cuts that a sample tells. The values of a block go, sorted and with how often they occur, to their
ranges; a range orders what it gets and the totals of the ranges before it give the ranks. A value counts once per block, so a hot
value does not crowd its range, and a range has about RANGE_VALUES rows up to MAX_RANGES of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import sized_broadcast, stored

BLOCK = 65_535  # rows; places in a block's list of values fit two bytes, ABSENT is left over
ABSENT = 65_535
RANGE_VALUES = 500_000
MAX_RANGES = 4096
SAMPLES_PER_RANGE = 32
PLACES, MOMENTS = -1, -2  # stand in place of a range for what stays with the block


def range_cuts(table: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """For each column the smallest values of its second and further ranges, told by a sample of at most 131,072 rows."""
    rows = table.count()
    ranges = min(MAX_RANGES, rows // RANGE_VALUES + 1)
    if ranges == 1:
        return [np.zeros(0) for _ in columns]
    sample = table.select(*columns).sample(min(1.0, SAMPLES_PER_RANGE * ranges / rows), 17).toArrow()
    cuts = []
    for c in columns:
        x = np.sort(_numbers(sample.column(c))[1])
        cuts.append(np.unique(x[np.arange(1, ranges) * len(x) // ranges]) if len(x) else x)
    return cuts


def _numbers(values) -> tuple[np.ndarray, np.ndarray]:
    """Which values are there, and those, with one zero only."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.is_valid().to_numpy(zero_copy_only=False), values.drop_null().to_numpy(zero_copy_only=False) + 0.0


def _blocks(batches):
    """The rows of a partition in tables of at most BLOCK rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _tallied(x: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the place of each row's value among them, and per value its rows and those with each of the marks."""
    values, places = np.unique(x, return_inverse=True)
    tally = np.zeros((len(values), 1 + marks.shape[1]), np.int32)
    tally[:, 0] = np.bincount(places, minlength=len(values))
    for j in np.flatnonzero(marks.any(axis=0)):
        tally[:, 1 + j] = np.bincount(places[marks[:, j]], minlength=len(values))
    return values, places, tally


def _cut(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of the rows from each start to the next."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(1, len(rows))
    offsets = np.append(starts, len(rows)).astype(np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _pieces(values: np.ndarray, tally: np.ndarray, cuts: np.ndarray):
    """A block's values by range: the ranges, and the values, the tallies and the totals of the tallies in each."""
    place = np.searchsorted(cuts, values, side="right")
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    return place[starts], _cut(values, starts), _cut(tally, starts), np.add.reduceat(tally, starts, axis=0, dtype=np.int64)


def _joined(pieces, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pieces.to_pylist()), kind)


def _ordered(values: np.ndarray, tally: np.ndarray):
    """Of values from many blocks: their order, the number of each row's value in it, and the sums of the tallies per value."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    return order, np.cumsum(new) - 1, np.add.reduceat(tally[order], np.flatnonzero(new), axis=0, dtype=np.int64)


def label_rank_sums(df: DataFrame, columns: list[Column], label: Column) -> DataFrame:
    """Per column (its place ``k``) with any value: rows ``n``, ``positives``, ``shifted``, the sum of the positives' ranks, each less the mean
    rank, and ``ties``, the sum of t^3 - t over its distinct values with t rows; ranks are averages among ties.

    ``label`` is 0 or 1; rows whose value is null take no part. ``df`` should be stored: it is read three times. The work runs when this is called.
    """
    names = [f"v{i}" for i in range(len(columns))]
    table = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names)], (label == 1).alias("y"))
    dealt = table.mapInArrow(_labelled(range_cuts(table, names)), "k int, range int, data binary, tally binary")
    sums = stored(dealt.groupBy("k", "range").applyInArrow(_label_sums, "k int, range int, n double, positives double, ranks double, ties double"), "ranks")
    below = F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    mid = (F.sum("n").over(W.partitionBy("k")) + 1) / 2
    return sums.withColumn("shifted", F.col("ranks") + F.col("positives") * (below - mid)).groupBy("k").agg(
        *[F.sum(c).alias(c) for c in ("n", "positives", "shifted", "ties")])


def _labelled(cuts: list[np.ndarray]):
    def run(batches):
        for block in _blocks(batches):
            y = block.column("y").fill_null(False).to_numpy()
            for k, c in enumerate(cuts):
                there, x = _numbers(block.column(f"v{k}"))
                if len(x):
                    values, n = np.unique(x, return_counts=True)
                    positive, hits = np.unique(x[y[there]], return_counts=True)
                    tally = np.zeros((len(values), 2), np.int32)
                    tally[:, 0] = n
                    tally[np.searchsorted(values, positive), 1] = hits
                    ranges, data, tallies, _ = _pieces(values, tally, c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranges), k, np.int32)), pa.array(ranges.astype(np.int32)), data, tallies],
                                                     ["k", "range", "data", "tally"])
    return run


def _label_sums(key, table):
    values = _joined(table.column("data"), np.float64)
    *_, sums = _ordered(values, _joined(table.column("tally"), np.int32).reshape(len(values), 2))
    n, positives = sums[:, 0], sums[:, 1]
    rank, t = np.cumsum(n) - n + (n + 1) / 2, n.astype(np.float64)
    found = n.sum(), positives.sum(), positives @ rank, (t * t * t - t).sum()
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "range": pa.array([key[1].as_py()], pa.int32()),
                     **{c: pa.array([float(v)]) for c, v in zip(("n", "positives", "ranks", "ties"), found)}})


def pair_correlations(df: DataFrame, columns: list[Column], pairs: list[tuple[int, int]]) -> DataFrame:
    """Per pair of columns (its place ``pair``) with any row that has both: such rows ``n``, Pearson's ``r`` and Spearman's ``rho``.

    Ranks are taken among the rows complete for the pair, averages among ties; a rank among all rows of a column less what lies below of
    the rows lacking the partner is one for any partner. A block's values come back from their ranges as ranks, in the same order.
    A correlation with a constant is null. All but the last step runs when this is called.
    """
    width = len(columns)
    names = [f"v{i}" for i in range(width)]
    table = stored(df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names)]), "numbers")
    blocks = stored(table.mapInArrow(
        _paired(range_cuts(table, names), pairs),
        "block long, k int, range int, totals array<long>, data binary, tally binary, moments array<double>"), "blocks")
    moments = _merged_moments(blocks.filter(F.col("range") == MOMENTS))
    rows = {r["pair"]: r["n"] for r in moments.select("pair", "n").collect()}

    values = blocks.filter("range >= 0")
    totals = values.groupBy("k", "range").agg(*[F.sum(F.col("totals")[j]).alias(f"t{j}") for j in range(1 + width)])
    before = W.partitionBy("k").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    below = stored(totals.select("k", "range", F.array(*[
        F.coalesce(F.sum(f"t{j}").over(before), F.lit(0)) for j in range(1 + width)]).alias("below")), "offsets")
    ranks = values.select("block", "k", "range", "data", "tally").join(sized_broadcast(below), ["k", "range"]).groupBy("k", "range").applyInArrow(
        _range_ranks, "block long, k int, range int, data binary, tally binary")
    places = blocks.filter(F.col("range") == PLACES).select("block", "k", "range", "data", "tally")
    sums = ranks.unionByName(places).groupBy("block").applyInArrow(_rank_products(pairs, rows, width), "pair int, xx double, yy double, xy double")
    rho = sums.groupBy("pair").agg(_ratio(F.sum("xy"), F.sum("xx"), F.sum("yy")).alias("rho"))
    return moments.join(F.broadcast(rho), "pair", "left")


def _ratio(xy: Column, xx: Column, yy: Column) -> Column:
    return F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))


def _merged_moments(blocks: DataFrame) -> DataFrame:
    """Rows and Pearson's r per pair from each block's rows, means and sums of squares and products.

    Means are taken from the smallest one, so that a constant column has no spread.
    """
    part = blocks.select(F.col("k").alias("pair"), *[F.col("moments")[i].alias(c) for i, c in enumerate(("n", "x", "y", "xx", "yy", "xy"))])
    whole = W.partitionBy("pair")
    shifted = part.withColumns({c: F.col(c) - F.min(c).over(whole) for c in "xy"})
    centred = shifted.withColumns({c: F.col(c) - F.sum(F.col("n") * F.col(c)).over(whole) / F.sum("n").over(whole) for c in "xy"})

    def total(sums: str, a: str, b: str) -> Column:
        return F.sum(F.col(sums) + F.col("n") * F.col(a) * F.col(b))

    return stored(centred.groupBy("pair").agg(
        F.sum("n").cast("long").alias("n"), _ratio(total("xy", "x", "y"), total("xx", "x", "x"), total("yy", "y", "y")).alias("r")), "moments")


def _paired(cuts: list[np.ndarray], pairs: list[tuple[int, int]]):
    def rows(block, k, ranges, totals=None, data=None, tally=None, moments=None) -> pa.RecordBatch:
        n = len(ranges)

        def listed(values, kind):
            return pa.nulls(n, pa.list_(kind)) if values is None else pa.array([v.tolist() for v in values], pa.list_(kind))

        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block, np.int64)), pa.array(np.broadcast_to(np.asarray(k, np.int32), n)), pa.array(np.asarray(ranges, np.int32)), listed(totals, pa.int64()),
             pa.nulls(n, pa.binary()) if data is None else data, pa.nulls(n, pa.binary()) if tally is None else tally, listed(moments, pa.float64())],
            ["block", "k", "range", "totals", "data", "tally", "moments"])

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for number, table in enumerate(_blocks(batches)):
            block, there, numbers = first + number, [], []
            for k in range(len(cuts)):
                valid, x = _numbers(table.column(f"v{k}"))
                whole = np.zeros(len(valid))
                whole[valid] = x
                there.append(valid)
                numbers.append(whole)
            lacking = ~np.column_stack(there)
            for k, c in enumerate(cuts):
                places = np.full(len(lacking), ABSENT, np.uint16)
                if there[k].any():
                    values, at, tally = _tallied(numbers[k][there[k]], lacking[there[k]])
                    places[there[k]] = at
                    ranges, data, tallies, totals = _pieces(values, tally, c)
                    yield rows(block, k, ranges, totals, data, tallies)
                yield rows(block, k, [PLACES], data=_cut(places, np.zeros(1, np.int64)))
            with np.errstate(invalid="ignore", over="ignore"):
                found = {p: _moments(numbers[a][both], numbers[b][both]) for p, (a, b) in enumerate(pairs) if (both := there[a] & there[b]).any()}
            if found:
                yield rows(block, list(found), [MOMENTS] * len(found), moments=found.values())
    return run


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows, means, and sums of squares and products about the means; taken from the first row, so that equal values have no spread."""
    n, dx, dy = len(x), x - x[0], y - y[0]
    mx, my = dx.mean(), dy.mean()
    dx, dy = dx - mx, dy - my
    return np.array([n, x[0] + mx, y[0] + my, dx @ dx, dy @ dy, dx @ dy])


def _steps(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each row less the one before it in its piece: small numbers, which compress well."""
    out = rows.copy()
    out[1:] -= rows[:-1]
    out[starts] = rows[starts]
    return out


def _range_ranks(key, table):
    """For the values of each block in a range twice their ranks in the column, and what to take off for each partner that rows lack."""
    values = _joined(table.column("data"), np.float64)
    tally = _joined(table.column("tally"), np.int32).reshape(len(values), -1)
    sizes = np.array([len(d) // 8 for d in table.column("data").to_pylist()])
    order, number, sums = _ordered(values, tally)
    below = np.array(table.column("below")[0].as_py(), np.int64)
    twice = 2 * (below + np.cumsum(sums, axis=0) - sums) + sums
    twice[:, 0] += 1
    out = np.empty((len(values), twice.shape[1]), np.int64)
    out[order] = twice[number]
    starts = np.cumsum(sizes) - sizes
    out = _steps(out, starts)
    return pa.table({"block": table.column("block"), "k": table.column("k"), "range": table.column("range"),
                     "data": _cut(out[:, 0], starts), "tally": _cut(out[:, 1:], starts)})


def _rank_products(pairs: list[tuple[int, int]], rows: dict[int, int], width: int):
    """Sums of squares and products of twice the ranks, less their mean, over a block's rows complete for each pair."""
    def run(key, table):
        places, pieces = {}, {k: [] for k in range(width)}
        listed = zip(*[table.column(c).to_pylist() for c in ("k", "range", "data", "tally")])
        for k, part, data, less in sorted(listed, key=lambda r: r[:2]):
            if part == PLACES:
                places[k] = np.frombuffer(data, np.uint16)
            else:
                ranks = np.cumsum(np.frombuffer(data, np.int64))
                pieces[k].append((ranks, np.cumsum(np.frombuffer(less, np.int64).reshape(len(ranks), width), axis=0)))
        ranks = {k: np.concatenate([p[0] for p in found]) for k, found in pieces.items() if found}
        less = {k: np.concatenate([p[1] for p in found]) for k, found in pieces.items() if found}
        out = []
        for p, (a, b) in enumerate(pairs):
            both = (places[a] != ABSENT) & (places[b] != ABSENT)
            if both.any():
                x, y = ((ranks[c] - less[c][:, d])[places[c][both]] - (rows[p] + 1.0) for c, d in ((a, b), (b, a)))
                out.append((p, float(x @ x), float(y @ y), float(x @ y)))
        pair, xx, yy, xy = zip(*out) if out else ([], [], [], [])
        return pa.table({"pair": pa.array(pair, pa.int32()), "xx": pa.array(xx, pa.float64()), "yy": pa.array(yy, pa.float64()), "xy": pa.array(xy, pa.float64())})
    return run
