import random
import zlib

import numpy as np
import plain
import pytest

from gaugesieve.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_terms_are_words_and_prefixes():
    rng = random.Random(3)
    pieces = ["Über", "straße", "lowei", "abcd", "abcde", "x", "42", "\U0001F600", "é", "-", ",", " ", " ", "\n", "\x00", "İı"]
    texts = ["", " ", "ABCDE abcde", "long " * 300_000 + "tail"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    hasher = toxicity.TermHasher()
    ours, theirs = [set(hasher.terms(t.encode()).tolist()) for t in texts], [plain.terms(t) for t in texts]
    for a, x in zip(ours, theirs):
        assert len(a) == len(x)
        for b, y in zip(ours, theirs):
            assert len(a & b) == len(x & y)
    known = hasher.terms(texts[10].encode())
    for text in texts:
        assert set(hasher.terms(text.encode(), known).tolist()) == set(hasher.terms(text.encode()).tolist()) & set(known.tolist())


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(1, 1 << 60, 30, dtype=np.uint64))
    machine = toxicity.FactorizationMachine(terms, rng.random(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    bags = [np.empty(0, np.uint64), terms[:1], terms[4:20], np.append(terms[::2], np.uint64(5)), terms]
    for bag, got in zip(bags, machine.score(bags)):
        at = [int(np.flatnonzero(terms == t)[0]) for t in bag if t in terms]
        z = machine.bias + sum(machine.weights[i] * machine.x[i] for i in at)
        z += sum(machine.factors[i] @ machine.factors[j] * machine.x[i] * machine.x[j] for n, i in enumerate(at) for j in at[:n])
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def pair_docs(n, seed):
    """Label 1 if insult and group belong together; each word alone says nothing."""
    rng, out = random.Random(seed), []
    for i in range(n):
        insult, group = rng.choice(("insa", "insb")), rng.choice(("grpa", "grpb"))
        words = [f"w{rng.randrange(60)}" for _ in range(12)] + [insult, group]
        rng.shuffle(words)
        out.append((i, " ".join(words), int(insult[-1] == group[-1])))
    return out


def test_pairs_that_no_linear_weights_tell_apart(spark):
    rows = pair_docs(3000, 8)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, epochs=40)
    label = {r[0]: r[2] for r in rows}
    held = [r for r in toxicity.score_toxicity(docs, machine).collect() if r.held_out]
    assert len(held) > 400 and np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9
    machine.factors = machine.factors * 0
    linear = [r for r in toxicity.score_toxicity(docs, machine).collect() if r.held_out]
    assert np.mean([r.predicted == label[r.doc_id] for r in linear]) < 0.65


def test_query_on_held_out_rows(spark):
    rows = queries.op13_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    known = [(r.predicted, toxic[r.doc_id], r.held_out) for r in rows if toxic.get(r.doc_id) is not None]
    held = [x for x in known if x[2]]
    assert sum(p == t for p, t, _ in held) >= 0.95 * len(held)
    assert sum(p for p, t, _ in known if t == 0) <= 0.01 * len(known) and sum(p for p, t, _ in known if t) >= 0.8 * sum(t for _, t, _ in known)


def test_held_out_rows_are_not_learned_from(spark):
    rows = pair_docs(300, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = [(r[0], r[2]) for r in rows]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int"), epochs=2) for x in (labels, turned))
    assert (a.terms == b.terms).all() and a.bias == b.bias and (a.factors == b.factors).all()


def test_awkward_tables(spark, awkward):
    docs, rows = awkward
    labels = "doc_id long, toxic int, id int, y int, text string"
    some = spark.createDataFrame([(4, 1, 1, 1, "a"), (5, 0, 1, 1, "a"), (9, 0, 1, 0, None), (None, 1, 1, 1, "b"), (6, None, 1, 1, "b"),
                                  (12, 1, 0, 0, ""), (12, 1, 0, 0, ""), (1, 0, 0, 0, "")], labels)
    wide = docs.withColumnsRenamed({"n": "held_out", "class": "predicted", "copies": "bits"})
    for table in (some, some.limit(0), some.filter("toxic = 1")):
        machine = toxicity.train(wide, table)
        got = toxicity.score_toxicity(wide.unionByName(wide), machine).collect()
        assert sorted(r.doc_id for r in got) == sorted([i for i, _ in rows] * 2)
        assert {r.score for r in got if r.doc_id == 1} == {r.score for r in got if r.doc_id == 2}
        assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.train(empty, some)).collect() == []
    null_id = spark.createDataFrame([(None, "x y")], "doc_id long, text string")
    assert [r.held_out for r in toxicity.score_toxicity(null_id, machine).collect()] == [False]


def test_rows_to_learn_from_are_bounded_and_weighted(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    chosen, weights = toxicity.choose_rows(labels, "doc_id", "toxic", 300)
    counts = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    assert sum(counts.values()) == 300 and counts[1] >= 140
    share = counts[1] * weights[1] / sum(counts[y] * weights[y] for y in counts)
    assert share == pytest.approx(0.1, abs=0.02)
