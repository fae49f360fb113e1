"""Exact Jaccard self-join on word shingles: grouped prefix join, and the classes of texts it links.

A document is the set of its distinct word shingles. Two documents link when the Jaccard similarity of their sets
reaches the threshold. Per step, with ``t`` the threshold and ``n`` the size of a set:

1. Equal sets are one class from the start; a class is compared once, however many copies it has.
2. Two linked sets share at least ``t * n`` of either one's shingles. A class that has more than ``n - t * n``
   shingles that no other class has links with nothing. Counting them among the shingles with a hash below a fixed
   bound, the ``pool_share``, already settles this for most classes, and those need no further work.
3. The shingles of the other classes are ordered by the number of classes that hold them, rarest first. Linked sets
   share a shingle among the first ``n - ceil(t * n) + 1``, the prefix. Classes of one size and one prefix form a
   group, and the postings of a shingle list groups.
4. Pairs of groups are filtered by their sizes and the places of the shared shingle, which bound the overlap.
   Groups expand to their members, whose whole sets are compared.
5. Not all pairs are compared. First each class of a posting list is compared with the list's leader. What these
   links connect is one component; then the pairs of a list that lie in different components, and only those, are
   compared. No link between components is lost, and a group of copies costs a row per member, not per pair.
6. All links: both ends of a link lie in one component. The whole sets of a component are dealt into chunks, and each
   pair of chunks is compared by lists of the shingles, which count the overlap of every pair that shares one. Each
   pair is met in one pair of chunks only.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.storage import sized_broadcast, stored
from gaugesieve.llm.batches import bounded_batches, small_batches
from gaugesieve.llm.components import components
from gaugesieve.llm.hashing import WordHasher, mixed, shingles

SETS = "doc long, class long, n long, words long, pool array<long>"
MEMBERS = "class long, n long, shingles array<long>"
LINKS = "a long, b long"
COUNTS = "class long, n_links long"
CHUNK_SHINGLES = 200_000  # about the shingles of a chunk of a large component
PAIRS_PER_COPY = 256  # a set that is in more pairs is repeated under a salt


def _batches(batches, width: int, pool_of):
    """For each small batch: the batch, word counts, class hashes and sizes of the shingle sets, and the kept part of each set."""
    hasher = WordHasher()
    for batch, texts in small_batches(batches, 1):
        words, first = hasher.texts(texts)
        sets = [shingles(words[a:b], width) for a, b in zip(first[:-1], first[1:])]
        sizes = np.array([len(s) for s in sets], np.int64)
        with np.errstate(over="ignore"):
            # Equal sets have equal sums of mixed members; the size is part of the class.
            sums = np.array([int(np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))) for s in sets], np.uint64)
            classes = mixed(sums + sizes.astype(np.uint64)).view(np.int64)
        yield batch, np.diff(first), classes, sizes, [pool_of(s) for s in sets]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, pool_share: float, carry: str | None = None) -> DataFrame:
    """(doc, class, n, words, pool): size and class of every shingle set, words of the text, and its hashes below the bound.

    ``carry`` names a column that is passed on as the string ``carried``.
    """
    def run(batches):
        bound = np.uint64(int(pool_share * 2**64))

        def pool(s):
            return s[:np.searchsorted(s, bound)]
        for batch, words, classes, sizes, kept in _batches(batches, width, pool):
            found = [batch.column(0), pa.array(classes), pa.array(sizes), pa.array(words.astype(np.int64)), _lists(kept)]
            names = ["doc", "class", "n", "words", "pool"]
            if carry is not None:
                found.append(batch.column(2))
                names.append("carried")
            yield pa.RecordBatch.from_arrays(found, names)

    columns = [F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if carry is None:
        return docs.select(*columns).mapInArrow(run, SETS)
    return docs.select(*columns, F.col(f"`{carry}`").cast("string").alias("carried")).mapInArrow(run, SETS + ", carried string")


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(class, n, shingles): the whole set of each wanted class, from the text of one document (class, doc) of it."""
    def run(batches):
        for batch, _, classes, sizes, sets in _batches(batches, width, lambda s: s):
            keep = np.flatnonzero(classes == batch.column(2).to_numpy())  # other rows with the same id have another class
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes[keep]), pa.array(sizes[keep]), _lists([sets[i] for i in keep])], ["class", "n", "shingles"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = source.join(wanted, source["doc"].eqNullSafe(wanted["doc"])).select(source["doc"], "text", "class")
    return found.mapInArrow(run, MEMBERS)


def linked_pairs(sets: list[np.ndarray], chunks: np.ndarray, up: int, down: int):
    """Places (x, others) of the sets that link with set x and come after it, for each x that has such.

    ``chunks`` has the chunk of each set; where there are two, only pairs across them are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    across = len(np.unique(chunks)) > 1
    left = np.flatnonzero(chunks == chunks.min()) if across else np.arange(len(sets))
    right = np.flatnonzero(chunks == chunks.max()) if across else left
    values = np.concatenate([sets[i] for i in right])
    owners = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    for x in left:
        lo, hi = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(owners[at], minlength=len(right))
        linked = shared * down >= (sizes[x] + sizes[right] - shared) * up
        if not across:
            linked &= right > x
        if linked.any():
            yield x, right[linked]


def compared(group: pa.Table, up: int, down: int):
    """Classes of a pair of chunks, and its linked pairs as places (x, others)."""
    shingled = group.column("shingles").combine_chunks()
    values, first = shingled.flatten().to_numpy(), np.concatenate([[0], np.cumsum(shingled.value_lengths().to_numpy())])
    chunks = group.column("chunk").to_numpy()
    classes = group.column("class").to_numpy()
    if group.column("i")[0].as_py() != group.column("j")[0].as_py() and chunks.min() == chunks.max():
        return classes, iter(())  # the other chunk is empty; this one is compared in its own group
    return classes, linked_pairs([values[a:b] for a, b in zip(first[:-1], first[1:])], chunks, up, down)


def _with_set(rows: DataFrame, pairs: DataFrame, whole: DataFrame, key: str, other: str, out: str) -> DataFrame:
    """``rows`` with the shingles of the class ``key`` as ``out``; the set of a class in many pairs is repeated under a salt.

    A leader of a large posting list is in a pair with each of its groups. One copy of its set goes to every
    PAIRS_PER_COPY of them, so there are never more copies than pairs.
    """
    many = stored(pairs.groupBy(key).agg(F.ceil(F.count("*") / F.lit(PAIRS_PER_COPY)).cast("int").alias("of")).filter("of > 1"), "many")
    many = sized_broadcast(many)
    salted = rows.join(many, key, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("of")), F.lit(0)).cast("int")).drop("of")
    sets = whole.select(F.col("class").alias(key), F.col("shingles").alias(out)).join(many, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1))).drop("of")
    return salted.join(sets, [key, "salt"]).drop("salt")


class JaccardJoin:
    """Links and classes of ``docs`` at Jaccard similarity ``threshold`` on shingles of ``width`` words.

    Null and empty texts, and texts of spaces only, have an empty set and link with nothing. A text with fewer words
    than ``width`` has one shingle, all of its words. Repeated rows and equal texts share a class. Other columns,
    whatever their names, are not read. A null id is allowed; it never becomes a component id unless all ids of the
    component are null.
    """

    def __init__(self, threshold: Fraction | str = "4/5", width: int = 5, pool_share: float = 0.3):
        self.t = Fraction(threshold)
        if not 0 < self.t <= 1:
            raise ValueError("threshold must be in (0, 1]")
        self.width, self.pool_share = width, pool_share

    def _needed(self, n: Column) -> Column:
        """ceil(t * n): the shingles that a linked set must share with a set of n."""
        up, down = self.t.numerator, self.t.denominator
        return F.floor((n * up + (down - 1)) / F.lit(down)).cast("long")

    def _fits(self, n1, rest1, n2, rest2) -> Column:
        """Sizes and what is left of both sets from the shared shingle on allow the overlap."""
        up, down = self.t.numerator, self.t.denominator
        # |x & y| >= t / (1 + t) * (|x| + |y|), in whole numbers.
        return (F.least(rest1, rest2) * (up + down) >= (n1 + n2) * up) & (
            F.least(n1, n2) * down >= F.greatest(n1, n2) * up)

    def fit(self, docs: DataFrame, id_col: str, text_col: str, carry: str | None = None) -> JaccardJoin:
        """Find ``sets`` (doc, class, n, words), ``joining`` (a, b: links enough to connect) and ``linked`` (node, component).

        A column named by ``carry`` is passed on in ``sets`` as ``carried``.
        """
        bounded_batches(docs.sparkSession)
        sets = stored(shingle_sets(docs, id_col, text_col, self.width, self.pool_share, carry), "sets")
        self.sets = sets.drop("pool")
        wanted = stored(self._candidates(sets), "wanted")
        classes = wanted.count()
        whole = stored(whole_sets(docs, sized_broadcast(wanted, classes), id_col, text_col, self.width), "whole")
        if whole.count() > classes:  # rows that repeat both id and text
            whole = stored(whole.dropDuplicates(["class"]), "whole")
        self.whole = whole
        postings, members = self._postings(whole)
        star = stored(self._verified(self._star_pairs(postings, members), whole), "links")
        joined = stored(components(star), "joined")
        rest = self._verified(self._open_pairs(postings, members, joined), whole)
        self.joining = stored(star.unionByName(rest), "links")
        self.linked = stored(components(self.joining), "linked")
        return self

    def _candidates(self, sets: DataFrame) -> DataFrame:
        """(class, doc) of the classes that are not ruled out by shingles of their own."""
        owners = sets.filter("n > 0").select("class", F.explode("pool").alias("s")).groupBy("s").agg(
            F.min("class").alias("class"), F.max("class").alias("other"))
        own = owners.filter("class = other").groupBy("class").agg(F.count("*").alias("own"))
        classes = sets.filter("n > 0").groupBy("class").agg(F.min("n").alias("n"), F.min("doc").alias("doc"))
        return classes.join(own, "class", "left").filter(
            F.coalesce("own", F.lit(0)) <= F.col("n") - self._needed(F.col("n"))).select("class", "doc")

    def _postings(self, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(s, grp, n, rest): the groups that have a shared shingle in their prefix; and (grp, class)."""
        single = whole.select("class", F.explode("shingles").alias("s"))
        shared = single.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
        ordered = single.join(shared, "s").groupBy("class").agg(
            F.array_sort(F.collect_list(F.struct("df", "s"))).alias("common"))
        n, own = F.col("n"), F.col("n") - F.size("common")
        length = n - self._needed(n) + 1 - own
        prefixed = ordered.join(whole.select("class", "n"), "class").filter(length > 0).select(
            "class", "n", own.alias("own"),
            F.transform(F.slice("common", 1, length.cast("int")), lambda e: e["s"]).alias("prefix"))
        # A set with a shingle of its own in the prefix shares the prefix with no other set.
        alone = F.when(F.col("own") > 0, F.col("class"))
        prefixed = stored(prefixed.withColumn("grp", F.xxhash64("n", "prefix", F.coalesce(alone, F.lit(0)))), "prefixes")
        groups = prefixed.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("n", "own", "prefix")])
        postings = groups.select("grp", "n", "own", F.posexplode("prefix").alias("place", "s")).select(
            "s", "grp", "n", (F.col("n") - F.col("own") - F.col("place")).alias("rest"))
        return postings, prefixed.select("grp", "class")

    def _star_pairs(self, postings: DataFrame, members: DataFrame) -> DataFrame:
        """Each group of a list with the list's leader, the group with most left; and members with their group's first."""
        one = members.groupBy("grp").agg(F.min("class").alias("rep"))
        best = postings.groupBy("s").agg(
            F.min(F.struct((F.col("n") - F.col("rest")).alias("before"), "grp", "n", "rest")).alias("lead"))
        pairs = postings.join(best, "s").filter(
            (F.col("grp") != F.col("lead.grp")) & self._fits(F.col("n"), F.col("rest"), F.col("lead.n"), F.col("lead.rest")))
        pairs = pairs.select(F.col("grp").alias("x"), F.col("lead.grp").alias("y")).distinct()
        left, right = one.select(F.col("grp").alias("x"), F.col("rep").alias("a")), one.select(
            F.col("grp").alias("y"), F.col("rep").alias("b"))
        across = pairs.join(left, "x").join(right, "y").select("a", "b")
        within = members.join(one, "grp").filter("class <> rep").select(F.col("class").alias("a"), F.col("rep").alias("b"))
        return across.unionByName(within)

    def _open_pairs(self, postings: DataFrame, members: DataFrame, joined: DataFrame) -> DataFrame:
        """All pairs of a list that pass the filter and lie in different components."""
        placed = members.join(joined, F.col("class") == F.col("node"), "left").select(
            "grp", "class", F.coalesce("component", "class").alias("comp"))
        entries = postings.join(placed, "grp").select("s", "n", "rest", "class", "comp")
        mixed_lists = entries.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        entries = stored(entries.join(mixed_lists.select("s"), "s"), "open")
        # Classes of one size, place and component are one side of a pair of sides; only pairs that fit expand.
        sides = entries.groupBy("s", "n", "rest", "comp").agg(F.count("*").alias("m"))
        left, right = sides.drop("m"), sides.select("s", *[F.col(c).alias(f"{c}2") for c in ("n", "rest", "comp")])
        fitting = left.join(right, "s").filter(
            (F.col("comp") < F.col("comp2")) & self._fits(F.col("n"), F.col("rest"), F.col("n2"), F.col("rest2")))
        key = ["s", "n", "rest", "comp"]
        other = entries.select("s", *[F.col(c).alias(f"{c}2") for c in ("n", "rest", "comp", "class")])
        pairs = fitting.join(entries, key).join(other, ["s", "n2", "rest2", "comp2"])
        return pairs.select(F.col("class").alias("a"), F.col("class2").alias("b"))

    def _verified(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the threshold."""
        pair = F.array_sort(F.array("a", "b"))
        pairs = stored(pairs.select(pair[0].alias("a"), pair[1].alias("b")).distinct(), "pairs")
        both = _with_set(_with_set(pairs, pairs, whole, "a", "b", "x"), pairs, whole, "b", "a", "y")
        both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
        union = F.size("x") + F.size("y") - F.col("i")
        return both.filter(F.col("i") * self.t.denominator >= union * self.t.numerator).select("a", "b")

    def _blocks(self):
        """The whole sets of all linked classes, a group for each pair of chunks of each component."""
        sets = self.whole.join(self.linked, F.col("class") == F.col("node"))
        totals = self.linked.join(self.whole, F.col("class") == F.col("node")).groupBy("component").agg(
            F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)).cast("int").alias("of"))
        large = stored(totals.filter("of > 1"), "large")
        chunked = sets.join(sized_broadcast(large), "component", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn(
            "chunk", F.pmod(F.xxhash64("class"), F.col("of")).cast("int"))
        other = F.sequence(F.lit(0), F.col("of") - 1)
        met = chunked.withColumn("other", F.explode(other)).select(
            "component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "class", "shingles")
        return met.groupBy("component", "i", "j")

    def links(self) -> DataFrame:
        """(a, b) with a < b: every pair of different classes that reaches the threshold, once."""
        up, down = self.t.numerator, self.t.denominator

        def run(group: pa.Table) -> pa.Table:
            classes, pairs = compared(group, up, down)
            found = [np.sort(np.stack([np.full(len(others), classes[x]), classes[others]]), axis=0) for x, others in pairs]
            a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            return pa.table({"a": pa.array(a), "b": pa.array(b)})
        return self._blocks().applyInArrow(run, LINKS)

    def link_counts(self) -> DataFrame:
        """(class, n_links): with how many other classes each linked class links; counted where the pairs are compared."""
        up, down = self.t.numerator, self.t.denominator

        def run(group: pa.Table) -> pa.Table:
            classes, pairs = compared(group, up, down)
            counts = np.zeros(len(classes), np.int64)
            for x, others in pairs:
                counts[x] += len(others)
                counts[others] += 1
            some = np.flatnonzero(counts)
            return pa.table({"class": pa.array(classes[some]), "n_links": pa.array(counts[some])})
        return self._blocks().applyInArrow(run, COUNTS).groupBy("class").agg(F.sum("n_links").alias("n_links"))

    def result(self, counted: bool = False) -> DataFrame:
        """(doc, n_shingles, component_id) per row of ``docs``; component_id is the smallest id that links reach.

        If ``counted``, also n_links: the links of the row's class with other classes. Copies are one class, so a link
        with a text counts once however many copies that has, and the row's own copies do not count.
        """
        classes = self.sets.filter("n > 0").groupBy("class").agg(F.min("doc").alias("least"), F.count("*").alias("rows"))
        linked = classes.join(self.linked, F.col("class") == F.col("node"))
        # A row per component, looked up by all of its classes.
        reached = sized_broadcast(stored(linked.groupBy("component").agg(F.min("least").alias("reached")), "reached"))
        ids = linked.join(reached, "component").select(F.col("class").alias("of"), "reached")
        # Only classes with several rows or links need an id other than the row's own.
        placed = classes.join(ids, F.col("class") == F.col("of"), "left").filter("rows > 1 OR of IS NOT NULL").select(
            "class", F.coalesce("reached", "least").alias("component_id"))
        columns = ["doc", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")]
        if counted:
            placed = placed.join(self.link_counts(), "class", "left")
            columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        return self.sets.join(sized_broadcast(stored(placed, "placed")), "class", "left").select(*columns)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc, n_shingles, component_id) per row of ``docs``; see ``JaccardJoin``."""
    return JaccardJoin(**settings).fit(docs, id_col, text_col).result()


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc, n_shingles, component_id, n_links) per row of ``docs``; see ``JaccardJoin.result``."""
    return JaccardJoin(**settings).fit(docs, id_col, text_col).result(counted=True)


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; all columns stay as they are.

    Rows whose text has no word link with nothing and stay. Rows that share an id stay or go together, but of rows
    that share id and text one stays.
    """
    found = stored(jaccard_classes(docs, id_col, text_col, **settings), "found")
    per_id = found.groupBy(F.col("doc").alias("of")).agg(
        F.min(~F.col("doc").eqNullSafe(F.col("component_id"))).alias("goes"), F.count("*").alias("rows"))
    marked = stored(per_id.filter("goes OR rows > 1"), "marked")
    # The rows travel in a struct, so that no column of theirs can clash with the helper's.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"))

    def met(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        return rows.join(sized_broadcast(table.select("of")), F.col("key").eqNullSafe(F.col("of")), how)

    kept, again = met(held, marked.filter("goes"), "left_anti"), marked.filter("NOT goes")
    if again.isEmpty():
        return kept.select("row.*")
    once = met(held, again, "left_semi").withColumn("text", F.col("row").getField(text_col)).dropDuplicates(["key", "text"]).drop("text")
    return met(kept, again, "left_anti").unionByName(once).select("row.*")
