"""Mixing sources to target weights: capped water-filling of the targets, seeded repetitions of the documents.

DataFrame functions only. A source's target is its share of the budget by weight, but never more than ``max_epochs``
times its size; what a clamped source cannot take is shared by weight among the others until none is above. The water
level is found in closed form: sources ordered by the share at which they clamp, with running sums.

Documents repeat whole: with ``e = target / size`` of their source, each is taken ``floor(e)`` times, and those first
in a seeded random order of the source once more, up to the fractional part of the target. The order is cut without
sorting a source: a digest puts each document into one of SLICES slices, sums per slice find the slice in which the
target is met, and only that slice is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import sized_broadcast, stored

SLICES = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights) -> DataFrame:
    """Add ``weight``: ``weights`` in turn over the sources by code point, null last. One row per source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.get(listed, F.pmod(place, F.lit(len(weights)))))


def water_filled(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): ``share`` of all sizes, capped and reshared by weight.

    Sources without words or without weight get 0. If all sources clamp, the targets sum to less than the budget.
    The windows run over one row per source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    usable = (F.col("weight") > 0) & (F.col("source_size") > 0)
    caps = sources.withColumns({"__cap": F.when(usable, cap).otherwise(F.lit(0.0)),
                                "__w": F.when(usable, F.col("weight")).otherwise(F.lit(0.0))})
    caps = caps.withColumn("__ratio", F.when(usable, F.col("__cap") / F.col("__w")))
    everything = W.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("__ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    # Level if exactly the sources up to this one clamp; the true level is the first that does not lift the next one.
    left = budget - F.sum("__cap").over(upto)
    weight_left = F.sum("__w").over(everything) - F.sum("__w").over(upto)
    levels = caps.withColumns({"__all": F.try_divide(budget, F.sum("__w").over(everything)),
                               "__level": F.when(weight_left > 1e-9, left / weight_left)})
    # With k sources clamped the level is right for the smallest k at which source k + 1 does not clamp.
    levels = levels.withColumns({"__place": F.row_number().over(order), "__next": F.lead("__ratio").over(order)})
    stands = F.when(F.col("__level") < F.col("__next"), F.struct("__place", "__level"))
    nothing_clamps = F.min("__ratio").over(everything) > F.col("__all")
    level = F.when(nothing_clamps, F.col("__all")).otherwise(F.min(stands).over(everything)["__level"])
    target = F.when(~usable, F.lit(0.0)).otherwise(
        F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap"))))
    return levels.select(*sources.columns, target.alias("target"))


def _plan(docs: DataFrame, text: Column, weights, share: float, max_epochs: float) -> DataFrame:
    """One row per source: its size and target, whole repetitions, and where the seeded order is cut."""
    slices = docs.groupBy("__source", "__slice").agg(F.sum(word_count(text)).alias("slice_size")).select(
        F.col("__source").alias("source"), F.col("__slice").alias("slice"), "slice_size")
    totals = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = water_filled(cyclic_weights(totals, weights), share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(epochs + F.lit(1e-12)).cast("long")).withColumn(
        "goal", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    below = slices.withColumn("below", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    goals = targets.select(F.col("source").alias("of"), F.col("goal").alias("of_goal"))
    meets = below.join(goals, F.col("source").eqNullSafe(F.col("of"))).filter(
        (F.col("of_goal") > 0) & (F.col("below") <= F.col("of_goal"))
        & (F.col("of_goal") < F.col("below") + F.col("slice_size"))).select("of", "slice", "below")
    return stored(targets.join(meets, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("whole").alias("__whole"), F.col("goal").alias("__goal"), F.col("slice").alias("__cut"),
        F.col("below").alias("__below")), "mix")


def _with_copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float,
                 max_epochs: float, seed: int) -> DataFrame:
    """``row``, the whole row as a struct, with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    In the struct no column of the table can clash with these.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, source = F.col("row")[text_col], F.col("row")[source_col].cast("string")
    placed = rows.withColumn("__source", source).withColumn(
        "__order", F.xxhash64(F.lit(seed), F.col("row")[id_col], "__source")).withColumn(
        "__slice", F.shiftrightunsigned("__order", 64 - (SLICES.bit_length() - 1)).cast("int"))
    plan = _plan(placed, text, weights, share, max_epochs)
    placed = placed.join(sized_broadcast(plan), F.col("__source").eqNullSafe(F.col("__of")))
    at_cut = F.coalesce(F.col("__slice") == F.col("__cut"), F.lit(False))
    inside = W.partitionBy("__source", "__slice").orderBy("__order").rangeBetween(W.unboundedPreceding, -1)
    decided = placed.filter(~at_cut).withColumn("__size", word_count(text)).withColumn(
        "__extra", F.coalesce(F.col("__slice") < F.col("__cut"), F.lit(False)))
    ranked = placed.filter(at_cut).withColumn("__size", word_count(text)).withColumn(
        "__extra", F.col("__below") + F.coalesce(F.sum("__size").over(inside), F.lit(0)) + F.col("__size") / 2
        <= F.col("__goal"))
    return decided.unionByName(ranked).withColumn("__copies", F.col("__whole") + F.col("__extra").cast("long")).select(
        "row", "__size", "__source_size", "__target", "__copies")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, copies) per row of ``docs``.

    ``copies`` says how often the mix takes the row whole; ``size * copies`` are its words in the mix. Rows with null
    or empty text have size 0. Null sources are one source of their own. Rows equal in id and source share a place
    in the order and are taken alike. The result is a function of the rows and the seed only. An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in (("id", id_col), ("text", text_col), ("source", source_col))])
    found = _with_copies(narrow, "id", "text", "source", weights, share, max_epochs, seed)
    return found.select(F.col("row.id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, columns as they are.

    Nulls, repeats and empty tables as in ``mixture``; columns of any name are kept.
    """
    found = _with_copies(docs, id_col, text_col, source_col, weights, share, max_epochs, seed)
    repeated = found.filter("__copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select("row.*")
