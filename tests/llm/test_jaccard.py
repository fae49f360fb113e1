import random

import plain
import pytest

from gaugesieve.llm import ngram_join
from gaugesieve.llm.components import components


def found(docs, **settings):
    return {r.doc: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs, **settings).collect()}


def near_copies(seed, groups=6, copies=12, noise=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(t)
    texts += [passage + [rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(noise)]
    rng.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(make_docs, seed):
    rows = near_copies(seed)
    assert found(make_docs([(i, t, "s") for i, t in rows])) == plain.jaccard_classes(rows)


def test_awkward_rows(awkward):
    docs, rows = awkward
    expected = plain.jaccard_classes(rows)
    assert found(docs) == expected
    assert expected[1] == (0, 1) and expected[5] == (1, 4) and expected[7][1] == 7  # only A-Z is lower-cased


def test_threshold_is_reached_exactly(make_docs):
    # 8 of 10 shingles shared is a link, 7 of 9 is none.
    link = [(1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l x")]
    assert plain.jaccard_classes(link) == found(make_docs([(i, t, "s") for i, t in link]))
    assert found(make_docs([(i, t, "s") for i, t in link]))[2] == (9, 1)
    none = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j x")]
    assert found(make_docs([(i, t, "s") for i, t in none]))[2] == (7, 2)


def test_empty_table(make_docs):
    assert found(make_docs([])) == {}
    assert ngram_join.one_per_class(make_docs([])).count() == 0


def test_one_per_class_keeps_columns_and_every_text_without_words(make_docs):
    text = "one two three four five six seven"
    docs = make_docs([(5, text, "a"), (3, text, "b"), (3, text, "b"), (8, "other words here", "a"), (9, None, None), (10, "", None)])
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.source) for r in kept.collect()) == [(3, "b"), (8, "a"), (9, None), (10, None)]


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (60, 7), (7, 60), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 61)}}


@pytest.mark.parametrize("chunk", [ngram_join.CHUNK_SHINGLES, 300])
def test_links_equal_all_pairs_within_components_too(make_docs, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", chunk)
    rows = near_copies(3)
    rows += [(1000 + i, t) for i, t in rows[:9]] + [(2000, None), (2001, "")]
    sets = {i: plain.shingle_set(t) for i, t in rows}
    kinds = list({s for s in sets.values() if s})
    pairs = [(x, y) for a, x in enumerate(kinds) for y in kinds[:a] if 5 * len(x & y) >= 4 * len(x | y)]
    docs = make_docs([(i, t, "s") for i, t in rows])
    join = ngram_join.JaccardJoin().fit(docs, "doc_id", "text")
    of = {r["class"]: sets[r.doc] for r in join.sets.collect()}
    links = [frozenset((of[r.a], of[r.b])) for r in join.links().collect()]
    assert len(links) == len(set(links)) and set(links) == {frozenset(p) for p in pairs}
    assert join.joining.count() < len(pairs)
    got = {r.doc: (r.n_shingles, r.component_id, r.n_links) for r in join.result(counted=True).collect()}
    assert got == {i: (*c, sum(sets[i] in p for p in pairs)) for i, c in plain.jaccard_classes(rows).items()}


def test_one_per_class_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 9), (2, text + " x", 8), (3, "other", 7), (3, "other", 7), (4, None, 6), (5, text, 5)]
    names = ("__doc", "of", "goes", "rows", "key", "row")
    docs = spark.createDataFrame([(i, t, *[n] * len(names)) for i, t, n in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.of) for r in kept.collect()) == [(1, 9), (3, 7), (4, 6)]


def test_a_leader_in_many_pairs(spark, monkeypatch):
    """More pairs with one leader than a copy of its set serves: the links stay those of all pairs."""
    monkeypatch.setattr(ngram_join, "PAIRS_PER_COPY", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(25)] + [(100 + i, " ".join(f"y{i}_{j}" for j in range(20))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == plain.jaccard_classes(rows)
