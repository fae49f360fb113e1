import oracle
import plain
import pytest

import corpus_pipeline
from gaugesieve.functions.storage import stored
from gaugesieve.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], con) == []


def test_jaccard_query_agrees_with_all_pairs(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_jaccard_join(spark, SF).collect()}
    assert got == plain.jaccard_classes(rows)


def test_every_stage_keeps_its_contract(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), "stage")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(i == least for i, (_, least) in plain.jaccard_classes(rows).items())
        if i == 2:
            assert all(plain.base_spans(r.text) == [] for r in docs.collect())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    assert docs.groupBy("shard", "bin").sum("n_words").filter("`sum(n_words)` > 2048").count() == 0


ROWS = {"op1_warc": "pages", "op4_mixing": "documents", "op5_quality": "documents", "op6_imatch": "documents", "op7_secrets": "documents",
        "op8_licenses": "documents", "op3_token_counts": "documents"}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query_has_a_row_for_each_of_the_table(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    key = "page_id" if ROWS[name] == "pages" else "doc_id"
    ids = sorted(r[0] for r in con.execute(f"SELECT {key} FROM {ROWS[name]}").fetchall())
    assert sorted(r[0] for r in got.select(key).collect()) == ids


def test_best_fit_query_places_every_word(spark, con):
    got = queries.op9_best_fit(spark, SF).collect()
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    placed = {}
    bins = {}
    for r in got:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_words
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert placed == {i: len(plain.words(t)) for i, t in text.items() if plain.words(t)}
    for pieces in bins.values():
        assert len({r.source for r in pieces}) == len(pieces) == len({r.cluster for r in pieces})
        assert sum(r.n_words for r in pieces) == pieces[0].bin_words <= 2048


def test_pipeline_on_awkward_documents(spark, awkward, tmp_path):
    docs, rows = awkward
    clashing = docs.withColumnsRenamed({"n": "__source", "class": "__doc", "size": "row", "copies": "__copies", "score": "of"})
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(4, 0, 0), (5, 1, 0), (6, 1, 1), (9, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stored(stage(spark, kept, str(tmp_path)), "stage")
        assert i == 4 or kept.columns == clashing.columns
    assert all(r.n_words > 0 for r in kept.collect())


def test_pipeline_on_no_documents(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
