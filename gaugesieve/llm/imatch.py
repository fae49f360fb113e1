"""I-Match fingerprints: hashes of the mid-frequency terms of a document under several randomised lexicon subsets.

DataFrame functions only. The lexicon holds the terms whose inverse document frequency lies in a band. Each of SUBSETS
random parts of it keeps a term with its own probability, from 1/8 down to 1/2048, so that long and short documents both
have subsets with few terms of theirs.

A document's distinct terms of the lexicon are sorted, once for all subsets: a term brings a key for each subset it is in,
the subset's number before the term's 57-bit hash, and the sorted keys are the sorted term lists of all subsets one after another. One
fold over them chains the 64-bit hash of each list. A fingerprint is these hashes; a document without any term of the lexicon has a digest of its whole text
instead. The likeness of two fingerprints is the share of equal hashes among the subsets that either document has terms of.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import sized_broadcast, stored

# Powers of two: a subset with entry b keeps a term with probability 2**-b. At most 63 subsets.
RATES = [3] * 2 + [4] * 6 + [5] * 10 + [6] * 12 + [7] * 10 + [8] * 8 + [9] * 6 + [10] * 4 + [11] * 2
SUBSETS = len(RATES)
SEPARATORS = r"[^\p{L}\p{N}]+"
HASH_BITS = 57
CUTS = 1024  # ranges of one level of the order by id


def terms_of(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""))


def lexicon(docs: DataFrame, text_col: str, low_idf: float, high_idf: float, seed: int) -> DataFrame:
    """(term, keys): the terms of the band that any subset has, with a key for each of their subsets."""
    total = docs.count()
    counts = docs.select(F.explode(terms_of(F.col(f"`{text_col}`"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))
    band = counts.filter((F.col("df") >= total * math.exp(-high_idf)) & (F.col("df") <= total * math.exp(-low_idf)))
    band = stored(band.select("term"), "band")  # else the filter on the keys would be drawn for every term of every document
    h = F.xxhash64(F.lit(seed + 1), F.col("term")).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    keys = []
    for j, b in enumerate(RATES):
        draw = F.xxhash64(F.lit(seed), F.lit(j), F.col("term")).bitwiseAND(F.lit((1 << b) - 1))
        keys.append(F.when(draw == 0, h + F.lit(j << HASH_BITS)))
    return stored(band.select("term", F.array_compact(F.array(*keys)).alias("keys")).filter(F.size("keys") > 0), "lexicon")


def subset_hashes(keys: Column) -> Column:
    """(used, parts) of a document's sorted keys: the bits of the subsets it has terms of, and a hash of each one's list."""
    start = F.struct(F.lit(-1).cast("long").alias("subset"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("used"),
                     F.array().cast("array<bigint>").alias("parts"))

    bits = F.array(*[F.lit(1 << j).cast("long") for j in range(SUBSETS)])

    def step(state: Column, key: Column) -> Column:
        subset = F.shiftrightunsigned(key, HASH_BITS)
        same = subset == state["subset"]
        done = F.when(same | (state["subset"] < 0), state["parts"]).otherwise(F.concat(state["parts"], F.array(state["h"])))
        return F.struct(subset.alias("subset"), F.xxhash64(F.when(same, state["h"]).otherwise(F.lit(0).cast("long")), key).alias("h"),
                        F.when(same, state["used"]).otherwise(state["used"] + F.get(bits, subset.cast("int"))).alias("used"),
                        done.alias("parts"))

    def end(state: Column) -> Column:
        return F.struct(state["used"].alias("used"), F.when(state["subset"] < 0, state["parts"]).otherwise(
            F.concat(state["parts"], F.array(state["h"]))).alias("parts"))
    return F.aggregate(keys, start, step, end)


def fingerprints(texts: DataFrame, keys: list[str], carried: list[str], words: DataFrame) -> DataFrame:
    """``keys``, ``carried`` and ``print`` (used, parts) per row of ``texts``. ``keys`` must be unique.

    Where the rows are already dealt by one of the keys, no term leaves its task.
    """
    marker = F.array(F.lit(None).cast("string"))  # keeps documents without terms
    single = texts.select(*keys, *carried, F.explode(F.concat(terms_of(F.col("text")), marker)).alias("term"))
    held = [F.when(F.col("term").isNull(), F.col(c)).alias(c) for c in carried]  # only the marker's row carries the rest
    found = single.select(*keys, *held, "term").join(sized_broadcast(words), "term", "left").filter("keys IS NOT NULL OR term IS NULL")
    summed = found.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], F.sort_array(F.flatten(F.collect_list("keys"))).alias("all"))
    return summed.select(*keys, *carried, subset_hashes(F.col("all")).alias("print"))


def shown(printed: Column, text_key: Column) -> Column:
    """The fingerprint as text, 8 hexadecimal digits of each hash; ``text_key`` is the digest of the whole text."""
    def short(p: Column, digits: int) -> Column:
        return F.lpad(F.lower(F.hex(p)), digits, "0")
    hashes = F.array_join(F.transform(printed["parts"], lambda p: short(F.shiftrightunsigned(p, 32), 8)), "")
    return F.when(printed["used"] != 0, F.concat(short(printed["used"], 16), F.lit("-"), hashes)).otherwise(
        F.concat(F.lit("text-"), short(text_key, 16)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either document has terms of; null where both have none."""
    return F.try_divide(F.size(F.array_intersect(a["parts"], b["parts"])), F.bit_count(a["used"].bitwiseOR(b["used"])))


def _place(cuts: Column, v: Column, most: int) -> Column:
    """How many of the ascending ``cuts``, at most ``most``, are not above ``v``, found by halving; 0 for null."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= v, step).otherwise(0))


def _with_range(rows: DataFrame, rows_per_range: int) -> DataFrame:
    """Add ``range``: ascending ranges of ids. Two levels of at most CUTS quantiles; the first are a literal of the plan, the
    second, one list per range, a small table."""
    ids = rows.select("doc_id")
    wanted = max(1, math.ceil(ids.count() / rows_per_range))

    def quantiles(parts: int) -> Column:
        return F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(max(10_000, 8 * parts)))

    coarse = min(CUTS, max(2, wanted))
    cuts = sorted(set(ids.agg(quantiles(coarse).alias("cuts")).first()["cuts"] or []))
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    ranged = rows.withColumn("range", _place(listed, F.col("doc_id"), CUTS).cast("long"))
    if wanted <= CUTS:
        return ranged
    fine = min(CUTS, math.ceil(wanted / CUTS) * 2)
    inner = stored(ranged.groupBy(F.col("range").alias("of")).agg(F.array_sort(F.array_distinct(quantiles(fine))).alias("inner")), "cuts")
    place = _place(F.col("inner"), F.col("doc_id"), CUTS)
    return ranged.join(F.broadcast(inner), F.col("range") == F.col("of")).withColumn(
        "range", F.col("range") * (CUTS + 1) + place).drop("of", "inner")


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 4096) -> DataFrame:
    """(doc_id, text, next_text) and where the row and its successor stand: range, place, next_range, next_place.

    The successor has the next id, that of the last row is the first. Ids are cut into ranges by approximate quantiles;
    each range also gets the first row of the next one, so no order is built over the whole table and texts are shuffled once.
    Rows with one id follow each other by a digest of their text; null ids come first. Null texts are empty.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ranged = _with_range(rows, rows_per_range)
    firsts = stored(ranged.groupBy("range").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).select(
        "range", F.when(F.col("nulls") == 0, F.col("least")).alias("first_id")), "ranges")
    # The guest of a range is the first row of the following range, after the last that of the first. A row per range.
    order = W.partitionBy(F.lit(1)).orderBy("range")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = F.lead(F.struct(F.col("range").alias("home"), "first_id")).over(order)
    around = F.first(F.struct(F.col("range").alias("home"), "first_id")).over(whole)
    hosts = stored(firsts.select(F.col("range").alias("host"), F.coalesce(following, around).alias("guest"),
                                 following.isNull().alias("wraps")).select("host", "guest.home", "guest.first_id", "wraps"), "hosts")
    visiting = rows.join(sized_broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "doc_id", "text", F.col("host").alias("range"), "home", F.lit(1).alias("guest"))
    everyone = ranged.select("doc_id", "text", "range", F.col("range").alias("home"), F.lit(0).alias("guest")).unionByName(visiting)
    order = W.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    after = F.lead(F.struct("text", "home", "guest")).over(order)
    placed = everyone.select("doc_id", "text", "range", "guest", F.row_number().over(order).cast("long").alias("place"), after.alias("after"))
    return placed.filter("guest = 0").select(
        "doc_id", "text", F.col("after.text").alias("next_text"), "range", "place", F.col("after.home").alias("next_range"),
        F.when(F.col("after.guest") == 0, F.col("place") + 1).otherwise(F.lit(1).cast("long")).alias("next_place"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half of code points, rounded down, replaced by the first as many of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low_idf: float = 1.0, high_idf: float = 7.0,
           seed: int = 11) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``.

    Equal texts have equal fingerprints. Null texts count as empty. Repeated rows give a row each. Other columns,
    whatever their names, are not read; an empty table gives an empty result.
    """
    words = lexicon(docs, text_col, low_idf, high_idf, seed)
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    carried = ["doc_id", "n_chars", "edited_sha256", "key", "next_range", "next_place"]
    sides = rows.select("place", "range", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                        "next_range", "next_place", F.inline(F.array(
                            F.struct(F.lit(0).alias("kind"), F.xxhash64("text").alias("key"), F.col("text").alias("text")),
                            F.struct(F.lit(1).alias("kind"), F.xxhash64("edited").alias("key"), F.col("edited").alias("text")))))
    printed = stored(fingerprints(sides, ["place", "range", "kind"], carried, words), "fingerprints")
    whole = printed.filter("kind = 0").drop("kind")
    other = printed.filter("kind = 1").select("range", "place", F.struct("key", "print").alias("edited"))
    following = whole.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.struct("key", "print").alias("next"))
    both = whole.join(other, ["range", "place"]).join(following, ["next_range", "next_place"])

    def near(side: str):
        return F.coalesce(likeness(F.col("print"), F.col(f"{side}.print")), (F.col("key") == F.col(f"{side}.key")).cast("double"))

    return both.select("doc_id", "n_chars", "edited_sha256", shown(F.col("print"), F.col("key")).alias("fingerprint"),
                       shown(F.col("edited.print"), F.col("edited.key")).alias("edited_fingerprint"),
                       near("edited").alias("near_edited"), near("next").alias("near_next"))
