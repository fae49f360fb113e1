import random

import pandas as pd
import plain
import pytest
from pyspark.sql import functions as F

from gaugesieve.llm import mixing, packing


def sized(sizes, seed=3):
    """Documents whose word counts add up to ``sizes`` per source."""
    rng, rows, n = random.Random(seed), [], 0
    for source, total in sizes.items():
        left = total
        while left:
            k = min(left, rng.randint(1, 9))
            rows.append((n, "w " * k, source))
            n, left = n + 1, left - k
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 3000, "b": 300, "c": 300}, {"a": 10, "b": 4000, "c": 500, "d": 40}, {None: 700, "": 100, "z": 2000}])
def test_targets_and_taken_words(make_docs, sizes):
    rows = mixing.mixture(make_docs(sized(sizes))).collect()
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ordered)}
    expected = plain.water_targets(sizes, weights, 1.5, 2.0)
    by_id = {i: s for i, _, s in sized(sizes)}
    for source in sizes:
        own = [r for r in rows if by_id[r.doc_id] == source]
        assert {r.source_size for r in own} == {sizes[source]}
        assert own[0].target == pytest.approx(expected[source])
        assert abs(sum(r.size * r.copies for r in own) - expected[source]) <= 9
        assert all(0 <= r.copies <= 2 for r in own)
    assert mixing.mixture(make_docs(sized(sizes))).orderBy("doc_id").collect() == sorted(rows, key=lambda r: r.doc_id)


def test_mixture_of_awkward_rows_and_of_nothing(awkward, make_docs):
    docs, rows = awkward
    got = {r.doc_id: r.size for r in mixing.mixture(docs).collect()}
    assert got == {i: len(plain.words(t)) for i, t in rows}
    assert mixing.mixture(make_docs([])).count() == 0
    assert mixing.mixture(make_docs([(1, None, "a"), (2, "", None)])).filter("target <> 0 OR copies <> 0").count() == 0


def test_mixed_rows_repeat_rows_as_the_mixture_says(make_docs):
    docs = make_docs(sized({"a": 100, "b": 900}))
    copies = {r.doc_id: r.copies for r in mixing.mixture(docs).collect() if r.copies}
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


def test_bins_equal_plain_best_fit():
    rng = random.Random(9)
    pieces = pd.DataFrame([(i, 0, 0, rng.randint(1, 40), rng.choice("aaabcdefgh"), rng.randint(0, 60), 0) for i in range(800)],
                          columns=["doc_id", "part", "first_word", "n_words", "source", "cluster", "shard"])
    got = packing.packed_shard(100, pieces)
    assert list(got["bin"]) == plain.best_fit(zip(got["n_words"], got["source"], got["cluster"]), 100)


def test_packing_keeps_words_and_conflicts(awkward):
    docs, rows = awkward
    got = packing.pack(docs, capacity=1000, shard_rows=4).collect()
    counts = {i: len(plain.words(t)) for i, t in rows}
    assert {i: sum(r.n_words for r in got if r.doc_id == i) for i in counts} == counts
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for pieces in bins.values():
        assert sum(r.n_words for r in pieces) == pieces[0].bin_words <= 1000
        assert len({r.source for r in pieces}) == len(pieces) == len({r.cluster for r in pieces})


def test_packing_of_nothing_repeats_and_a_named_cluster(make_docs):
    assert packing.pack(make_docs([])).count() == 0
    rows = packing.pack(make_docs([(1, "a b", "x"), (1, "a b", "x"), (2, "A  b", None), (3, "c", "y")]), capacity=10).collect()
    assert len({(r.shard, r.bin) for r in rows}) == 3 and len(rows) == 4
    named = packing.pack(make_docs([(1, "a", "x"), (2, "b", "y")]).withColumn("g", F.lit(1)), cluster_col="g").collect()
    assert len({(r.shard, r.bin) for r in named}) == 2


def test_near_copies_from_other_sources_are_in_other_bins(make_docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text + " more", "b"), (3, text.upper(), "c"), (4, "other words", "d"), (4, text + " last", "e"),
            (5, None, "f"), (6, "", "g"), (7, "É è", "h"), (8, "é  È", "i")]
    got = packing.pack_near(make_docs(rows), capacity=200).collect()
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r.source)
    assert sorted(r.source for r in got) == list("abcdehi") and len({r.cluster for r in got}) == 3
    assert all(len(set("abce") & set(b)) <= 1 and len(set("hi") & set(b)) <= 1 for b in bins.values())


def test_columns_of_any_name_stay_as_they_are(spark):
    names = ("__source", "__size", "__order", "row", "__copies", "source_size")
    rows = [(i, f"word{i} " * (i % 9), "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert all(r[n] == f"{n}{r.doc_id}" for r in mixed.collect() for n in names)
    copies = {r.doc_id: r.copies for r in mixing.mixture(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


def test_near_packing_of_nothing(make_docs):
    assert packing.pack_near(make_docs([])).collect() == []
    assert packing.pack_near(make_docs([(1, None, "a"), (2, " ", None)])).collect() == []
    twice = packing.pack_near(make_docs([(1, "a b", "x"), (1, "a b", "x"), (1, "c d e", "x")]), capacity=10).collect()
    assert sorted(r.n_words for r in twice) == [2, 2, 3] and len({(r.shard, r.bin) for r in twice}) == 3
