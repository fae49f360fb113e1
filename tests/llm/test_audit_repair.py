import random

import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugesieve.llm import conversation_repair as repair
from gaugesieve.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int, id int, digest string, n int, good int, of int, mask int"


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 0, 3, 4) for r in rows], LABELS)


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_agrees_with_document_by_document(spark):
    random.seed(1)
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", long, long, "AB CD " * 60, "x # y", "a b " * 200, "\t \n", "é" * 300] + [
        " ".join(random.choice(("ab", "Cd", "e%", "FG")) + str(random.randrange(random.choice((3, 400)))) for _ in range(random.choice((20, 150))))
        for _ in range(20)]
    rows = [(i, random.choice(texts), random.choice(("en", "de", None, ""))) for i in range(90)]
    rows += [rows[5], rows[5], rows[7], (None, long, "en"), (None, "", None)]
    labels = [(i, random.choice((0, 1, None)), random.choice((0, 1, None))) for i in random.choices(range(95), k=60)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, mask int, part string, n double")
    assert audited(filter_audit.audit_corpus(docs, labels_of(spark, labels))) == plain.order_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit_corpus(docs, labels_of(spark, [])).collect() == []
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    found = audited(filter_audit.audit_corpus(one, labels_of(spark, [])))
    assert len(found) == 600 and found == plain.order_audit([(1, None, None)], [])


def test_orders_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 1, 4, 1), ("p", 3, 2, 2), (None, 0, 5, 0)], "part string, mask int, n long, lost long")
    rows = {(r.part, r.filter_order, r.step): r for r in filter_audit.order_audit(cells, "XY", ["lost"]).collect()}
    assert len(rows) == 8
    assert (rows["p", "YX", 1].removed, rows["p", "YX", 2].removed, rows["p", "YX", 2].redundant) == (2, 4, 2)
    assert rows["p", "XY", 1].lost == 3 and rows["p", "XY", 1].shapley == 10 and rows["p", "XY", 2].unique_fails == 0
    assert rows[None, "XY", 2].kept == 5
    with pytest.raises(ValueError):
        filter_audit.order_audit(cells, "ABCDEFG", [])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(("s", "u", "a", "")), st.sampled_from(("", "", "", "truncated", "blank", "duplicate"))),
                max_size=12), st.sampled_from((1, 2, 3, 64)))
def test_search_finds_the_first_of_the_cheapest(rows, block):
    coded = bytes(repair.INITIALS.get(i, 0) | (0 if not f else repair.CUT if f == "truncated" else repair.GOES) for i, f in rows)
    assert repair.repair(coded, block) == plain.cheapest_edits(rows)


def test_long_conversation_in_blocks():
    random.seed(2)
    rows = [(random.choice("uuas"), random.choice(("", "", "truncated", "blank"))) for _ in range(1500)]
    coded = bytes(repair.INITIALS[i] | (0 if not f else repair.CUT if f == "truncated" else repair.GOES) for i, f in rows)
    assert repair.repair(coded) == plain.cheapest_edits(rows)


def repaired(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    found = {r[0]: tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_repair_query_agrees_with_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(queries.op12_conversation_repair(spark, SF)) == plain.repaired_conversations(rows)


def test_repair_of_awkward_conversations(spark):
    random.seed(4)
    texts = ("Yes.", "No", "", " \t", None, "é!", "x" * 100_000, "Hm?  \n", "a ", "\U0001F600")
    rows = [(c, random.choice((None, t, t, 3)), random.choice(("user", "assistant", "system", "User", "", "tool", None, "unknown")),
             random.choice(texts)) for c in [None, *range(40)] for t in range(random.randrange(1, 9))]
    rows += rows[:10] + [(50, 1, "user", "Same.")] * 300 + [(51, t, "user", "Same.") for t in range(300)]
    dropped = next(c for c in range(100, 200) if not plain.damaged_rows([(c, 0, "user", "x")]))
    rows.append((dropped, 0, "user", "x"))
    table = spark.createDataFrame([(*r, "x", True, 1) for r in rows],
                                  "conv_id long, turn long, role string, text string, conv string, there boolean, kind int")
    found = repaired(repair.repair_conversations(repair.damaged(table)))
    assert found == plain.repaired_conversations(rows)
    assert found[dropped][:7] == (0, 0, 0, 0, 0, 0, "")
    assert repair.repair_conversations(repair.damaged(table.limit(0))).collect() == []
