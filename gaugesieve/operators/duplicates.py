"""Duplicates over whole rows, ids and measurement vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gaugesieve.functions.scale import MAX_HOT_KEYS, mark_hot, spread_salt
from gaugesieve.functions.storage import BROADCAST_ROWS, sized_broadcast, stored
from gaugesieve.spec import MeasurementSpec

# Flag names.
DUPLICATE_FLAGS = ("duplicate_full_row", "duplicate_test_id", "duplicate_measurement_pair")
# End of fixed values.

BLOCK = 100_000


def _cols(names):
    return [F.col(f"`{n}`") for n in names]


def _digest(df: DataFrame, names) -> Column:
    """128 bits of the named columns; NULL equals NULL and -0.0 equals 0.0. Two different keys share them with a probability of 2^-128."""
    values = [_one_zero(df, n) for n in names]
    gaps = [v.isNull() for v in values]  # hashing passes over NULL
    return F.struct(F.xxhash64(F.lit(1), *values, *gaps).alias("a"), F.xxhash64(F.lit(2), *values, *gaps).alias("b"))


def _one_zero(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    value = F.col(f"`{name}`")
    return value + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def _with_repeated(df: DataFrame, rows: DataFrame, names, out: str, salts: int) -> DataFrame:
    """Add ``out`` to ``rows``: the key occurs more than once in ``df``.

    Only the keys' digests are counted, combined before they move. The repeated ones are broadcast if they are few; if not, the
    most repeated are broadcast and the rows that have them spread, and the others are looked up by a shuffle.
    """
    counted = df.select(_digest(df, names).alias("__of")).groupBy("__of").agg(F.count(F.lit(1)).alias("__n"))
    repeated = stored(counted.filter("__n > 1"), "repeated")
    number = repeated.count()
    keyed = rows.withColumn("__key", _digest(rows, names))
    if number <= BROADCAST_ROWS:
        found = keyed.join(F.broadcast(repeated), F.col("__key") == F.col("__of"), "left")
        return found.withColumn(out, F.col("__n").isNotNull()).drop("__key", "__of", "__n")
    hot = repeated.orderBy(F.desc("__n"), "__of").limit(MAX_HOT_KEYS).select(F.col("__of").alias("__key"))
    marked = mark_hot(keyed, hot, ["__key"], "__hot")
    spread = F.struct(spread_salt(rows, salts).alias("a"), F.lit(None).cast("long").alias("b"))
    found = marked.withColumn("__key", F.when(F.col("__hot"), spread).otherwise(F.col("__key"))).join(
        repeated, F.col("__key") == F.col("__of"), "left")
    return found.withColumn(out, F.col("__hot") | F.col("__n").isNotNull()).drop("__key", "__hot", "__of", "__n")


def duplicate_flags(df: DataFrame, spec: MeasurementSpec, salts: int = 256,
                    hot_fraction: float | None = None, block: int = BLOCK) -> DataFrame:
    """Add the three duplicate flags; rows and their multiplicity stay as they are, but for -0.0, which becomes 0.0.

    * full row: every copy but one of a group of identical rows;
    * id: the id occurs more than once;
    * measurement pair: the feature vector occurs more than once, NULL equal to NULL.

    Ids and vectors that repeat are found by counting narrow digests when this is called; whole rows move only where both repeat, as identical
    rows share both. Such rows are counted into one row (combined before the shuffle) and unfolded at the end, block by block, so a
    huge group of copies is neither gathered nor written by one task. ``hot_fraction`` is not needed any more: all counts are known.
    """
    columns, id_key, vector = df.columns, spec.present(df, [spec.id_col]), spec.present(df)
    flags = ["duplicate_test_id", "duplicate_measurement_pair"]
    marked = _with_repeated(df, df, id_key, flags[0], salts) if id_key else df.withColumn(flags[0], F.lit(False))
    marked = _with_repeated(df, marked, vector, flags[1], salts)
    may_be_copies = F.col(flags[1]) & F.col(flags[0]) if id_key else F.col(flags[1])
    alone = marked.filter(~may_be_copies).select(
        *[_one_zero(df, c).alias(c) for c in columns], F.lit(False).alias("duplicate_full_row"), *flags)

    counted = marked.filter(may_be_copies).groupBy(*_cols(columns), *flags).agg(F.count(F.lit(1)).alias("__copies"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / block))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = counted.withColumn("__block", F.explode(blocks)).repartition(parts, *_cols(columns), "__block")
    first = F.col("__block") * block + 1
    last = F.least(F.col("__copies"), (F.col("__block") + 1) * block)
    several = blocked.withColumn("__copy", F.explode(F.sequence(first, last))).select(
        *_cols(columns), (F.col("__copy") > 1).alias("duplicate_full_row"), *flags)
    return alone.unionByName(several)


def duplicate_flags_by_fold(folds: DataFrame, spec: MeasurementSpec, k: int, fold: str = "fold") -> DataFrame:
    """The duplicate flags of every row in each of k splits, from one count per key and fold.

    In split i the rows of fold i are one part and all others the other, and a flag tells whether the row is a duplicate within its part. The
    count of a key outside a fold is its total less the count inside, so nothing is counted again per split. Adds
    ``duplicate_full_row`` and two arrays with an entry per split. Identical rows must share a fold. Only keys that
    repeat are joined back.
    """
    columns = folds.columns
    row_key, id_key, vector = [c for c in columns if c != fold], spec.present(folds, [spec.id_col]), spec.present(folds)
    keyed = stored(folds.withColumns({"__row": _digest(folds, row_key), "__id": _digest(folds, id_key), "__vector": _digest(folds, vector)}), "keys")
    flagged = keyed
    per_fold = [F.count_if(F.col(fold) == i + 1).alias(f"n{i}") for i in range(k)]
    for name, out in (("__id", "duplicate_test_id"), ("__vector", "duplicate_measurement_pair")):
        repeated = keyed.groupBy(F.col(name).alias("of")).agg(*per_fold, F.count("*").alias("n")).filter("n > 1").select(
            "of", F.array(*[F.col(f"n{i}") for i in range(k)]).alias("in_fold"), "n")
        repeated = sized_broadcast(stored(repeated, "repeated"))
        in_part = F.transform("in_fold", lambda c, i: F.when(F.col(fold) == i + 1, c).otherwise(F.col("n") - c) > 1)
        never = F.array_repeat(F.lit(False), k)
        flagged = flagged.join(repeated, F.col(name) == F.col("of"), "left").withColumn(
            out, F.coalesce(in_part, never) if spec.present(folds, [spec.id_col]) or name != "__id" else never).drop("of", "in_fold", "n")
    # Which copy of an identical row a row is does not matter; the copies are numbered where there are any.
    copies = stored(keyed.groupBy(F.col("__row").alias("of")).agg(F.count("*").alias("n")).filter("n > 1").select("of"), "copies")
    marked = flagged.join(sized_broadcast(copies), F.col("__row") == F.col("of"), "left")
    place = F.row_number().over(W.partitionBy("__row").orderBy(F.lit(1)))
    alone = marked.filter("of IS NULL").withColumn("duplicate_full_row", F.lit(False))
    several = marked.filter("of IS NOT NULL").withColumn("duplicate_full_row", place > 1)
    return alone.unionByName(several).drop("__row", "__id", "__vector", "of")


def duplicate_groups(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """One row per group of identical rows: the row and how often it occurs."""
    return (df.groupBy(*_cols(df.columns)).agg(F.count(F.lit(1)).alias("GroupSize"))
            .filter("GroupSize > 1"))


def duplicate_group_sizes(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """How many groups there are of each size, groups being formed without the id."""
    by = [c for c in df.columns if c != spec.id_col]
    sizes = duplicate_groups(df, spec).groupBy(*_cols(by)).agg(F.sum("GroupSize").alias("GroupSize"))
    return sizes.groupBy("GroupSize").agg(F.count(F.lit(1)).alias("Groups"))


def duplicate_report(df: DataFrame, spec: MeasurementSpec, max_ids: int = 20) -> DataFrame:
    """One summary row: duplicated rows, groups, smallest and largest group, first affected ids.

    All sizes: ``duplicate_group_sizes``; all groups: ``duplicate_groups``.
    """
    groups = duplicate_groups(df, spec)
    by = [c for c in df.columns if c != spec.id_col]
    sizes = groups.groupBy(*_cols(by)).agg(F.sum("GroupSize").alias("size"))
    summary = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("TotalDuplicateRows"),
        F.count(F.lit(1)).alias("UniqueDuplicateGroups"),
        F.min("size").alias("SmallestGroup"), F.max("size").alias("LargestGroup"))
    if spec.id_col not in df.columns:
        return summary.withColumn("AffectedTestIDs", F.lit("None"))
    # At most max_ids copies of any one row can be among the first max_ids ids.
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("GroupSize"), F.lit(max_ids))))
    first = groups.select(F.col(f"`{spec.id_col}`").alias("id"), copies.alias("copy")).orderBy("id").limit(max_ids)
    ids = first.agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("ids"))
    text = F.concat_ws(", ", "ids")
    return summary.withColumn("ids", ids.scalar()).withColumn(
        "AffectedTestIDs", F.when(text == "", "None").otherwise(text)).drop("ids")


def repeated_ids(df: DataFrame, spec: MeasurementSpec) -> DataFrame:
    """Per repeated id: rows, and whether every row has a twin measurement under that id.

    No rows when no id repeats. Both levels combine before their shuffle.
    """
    vector = spec.present(df)
    per_vector = df.groupBy(F.col(spec.id_col), *_cols(vector)).agg(F.count(F.lit(1)).alias("n"))
    per_id = per_vector.groupBy(spec.id_col).agg(
        F.sum("n").alias("RepeatCount"), F.min("n").alias("fewest"))
    verdict = F.when(F.col("fewest") > 1, "Exact Duplicate Measurements").otherwise(
        "Same Test_ID Differing Measurements")
    return per_id.filter("RepeatCount > 1").select(
        F.col(spec.id_col).cast("string").alias(spec.id_col), "RepeatCount",
        verdict.alias("Classification"), F.lit(len(vector)).alias("PhysicalFeaturesEvaluated"))
