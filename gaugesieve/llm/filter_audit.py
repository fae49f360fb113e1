"""What each filter removes under every order of the filters: an audit by folds over failure masks.

A document's failures are a bit mask, one bit per filter. Rows are counted into cells, one per part and mask, so a part
has at most 2^filters cells whatever its size. The orders are one array literal of the plan, n! arrays of filter numbers.
Each cell folds over it: ``transform`` takes an order, ``aggregate`` walks its steps and
carries whether the cell's documents are still there, and every step leaves a struct of what the cell adds to it,
weighted by the cell's counts. The arrays of a part's cells, n! * n structs each, are merged by elementwise sums.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILTERS = 6  # 720 orders of 6 steps; the arrays grow with the factorial
BLANKS = "\t\n\x0b\x0c\r"
SUMS = ("kept", "removed", "redundant", "unique_fails")


def words(text: Column) -> Column:
    """The runs of characters other than the six ASCII blanks."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def corpus_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null: few words, repetitive, capitals, odd characters."""
    listed = words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(listed) < 100,
        "B": 100 * F.size(F.array_distinct(listed)) < 80 * F.size(listed),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def counted_masks(docs: DataFrame, failures: dict[str, Column], part: Column, id_col: str, copy_key: Column) -> DataFrame:
    """(digest, part, mask, id, n): rows by copy key, part, failure mask (bit i for the i-th failure) and id.

    A failure that is null counts as false. Only these narrow counts move; repeated rows become one before they do.
    """
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())]
    rows = docs.select(copy_key.alias("digest"), part.alias("part"), reduce(lambda a, b: a + b, bits).alias("mask"),
                       F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.groupBy("digest", "part", "mask", "id").agg(F.count("*").alias("n"))


def mask_cells(rows: DataFrame, losses: list[str], copy_bit: int) -> DataFrame:
    """(part, mask, n, losses): the sums of ``rows`` per part and mask, ``copy_bit`` added where a smaller id has the digest.

    ``rows`` are ``counted_masks`` with a count per loss. They are summed per digest without the ids, the smallest id's
    own counts beside, so a text with any number of copies becomes a few rows and nothing is joined back. A null id is not smaller than any and has no smaller one.
    """
    sums = ["n", *losses]
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *sums))).alias("first")
    without = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"null_{c}") for c in sums]
    per_text = rows.groupBy("digest", "part", "mask").agg(first, *[F.sum(c).alias(c) for c in sums], *without)
    least = per_text.groupBy("digest").agg(F.min("first.id").alias("least"), F.collect_list(F.struct(
        "part", "mask", "first", *sums, *[f"null_{c}" for c in sums])).alias("cells"))
    cells = least.select("least", F.inline("cells"))
    own = {c: F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(F.lit(0).cast("long")) + F.col(f"null_{c}")
           for c in sums}
    both = F.array(F.struct("part", "mask", *[own[c].alias(c) for c in sums]),
                   F.struct("part", (F.col("mask") + copy_bit).alias("mask"), *[(F.col(c) - own[c]).alias(c) for c in sums]))
    return cells.select(F.inline(both)).filter("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums])


def _steps(order: Column, losses: list[str]) -> Column:
    """What a cell (columns mask, n and losses) adds to each step of ``order``, an array of filter numbers."""
    zero = F.lit(0).cast("long")
    kinds = [*SUMS, *losses]
    empty = F.array().cast("array<struct<%s>>" % ",".join(f"{k}:bigint" for k in kinds))
    start = F.struct(F.lit(True).alias("there"), empty.alias("steps"))

    def walk(state: Column, f: Column) -> Column:
        fails = F.getbit("mask", f)
        there = state["there"]
        gone = there & (fails == 1)

        def of(condition: Column, weight: str = "n") -> Column:
            return F.when(condition, F.col(weight)).otherwise(zero)

        step = F.struct(
            of(there & (fails == 0)).alias("kept"), of(gone).alias("removed"), of(~there & (fails == 1)).alias("redundant"),
            of((fails == 1) & (F.bit_count("mask") == 1)).alias("unique_fails"),
            *[of(gone, name).alias(name) for name in losses])
        return F.struct((there & (fails == 0)).alias("there"), F.concat(state["steps"], F.array(step)).alias("steps"))

    return F.aggregate(order, start, walk, lambda state: state["steps"])


def order_audit(cells: DataFrame, letters: str, losses: list[str]) -> DataFrame:
    """One row per part, order of ``letters`` and step, zeros included; see the module's text.

    Columns: part, filter_order, step (from 1), kept (after the step), removed (by it), redundant (fail its filter, removed
    earlier), unique_fails (fail its filter only), a column per loss (of the removed), and shapley (what its filter removes,
    summed over all orders). Parts are those of ``cells``; no cells, no rows. A null part is a part.
    """
    filters = len(letters)
    if not 0 < filters <= MAX_FILTERS or len(set(letters)) < filters:
        raise ValueError(f"from one to {MAX_FILTERS} filters, each with a letter of its own")
    orders = list(permutations(range(filters)))
    listed = F.array(*[F.array(*[F.lit(f) for f in order]) for order in orders])
    kinds = [*SUMS, *losses]
    folded = cells.select("part", F.flatten(F.transform(listed, lambda order: _steps(order, losses))).alias("steps"))
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(k) for k in kinds]), len(orders) * filters)

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(*[(x[k] + y[k]).alias(k) for k in kinds]))

    # At most 2^filters arrays of a part meet.
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("arrays")).select(
        "part", F.aggregate("arrays", zeros, add).alias("steps"))
    # The filter of place p is flat[p]; what a filter removes is summed over the places that have it.
    flat = [f for order in orders for f in order]
    places = F.split(F.lit(",".join(map(str, flat))), ",").cast("array<int>")
    per_filter = F.transform(F.sequence(F.lit(0), F.lit(filters - 1)), lambda f: F.aggregate(
        F.zip_with("steps", places, lambda s, p: F.when(p == f, s["removed"]).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a + x))
    names = F.split(F.lit(",".join("".join(letters[f] for f in order) for order in orders)), ",")
    rows = merged.withColumn("totals", per_filter).select("part", "totals", F.posexplode("steps").alias("place", "s"))
    return rows.select(
        "part", F.get(names, F.floor(F.col("place") / filters).cast("int")).alias("filter_order"),
        (F.col("place") % filters + 1).cast("int").alias("step"), *[F.col(f"s.{k}").alias(k) for k in kinds],
        F.get("totals", F.get(places, "place")).alias("shapley"))


def audit_corpus(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang") -> DataFrame:
    """``order_audit`` of the five corpus filters A to E per ``part_col``, with losses of good and of toxic documents.

    Null texts count as empty, a null part as the empty string. A document is good or toxic if any of its label rows has a
    1; ids without labels and null ids are neither. Repeated rows count each; rows that share a text and its smallest id
    are not copies of each other. Empty tables give no rows. Other columns, whatever their names, are not read.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("of"), F.col("quality") == 1, F.col("toxic") == 1).toDF(
        "of", "good", "toxic").filter("of IS NOT NULL").groupBy("of").agg(
        F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    failures = corpus_failures(text)
    rows = counted_masks(docs, failures, F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")), id_col, F.sha2(text, 256))
    none = F.lit(0).cast("long")
    losses = {name: F.when(F.col(kind), F.col("n")).otherwise(none).alias(name)
              for name, kind in (("good_lost", "good"), ("toxic_lost", "toxic"))}
    labelled = rows.join(known, F.col("id") == F.col("of"), "left").select("digest", "part", "mask", "id", "n", *losses.values())
    return order_audit(mask_cells(labelled, list(losses), 1 << len(failures)), "ABCDE", list(losses))
