import gzip
import os

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from gaugesieve.llm import queries, token_scan, topk, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, __digest string, n int, digest string, first long, of int, least int, payload string, id int"


def round_trip(spark, tmp_path, rows, **settings):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([(*r, "x", 1, "d", 2, 3, 4, "p", 5) for r in rows], PAGES), path, **settings)
    return path, warc.read_warc(spark, path)


def test_pages_come_back(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(4, "http://a/", "same"), (2, None, "same"), (3, "http://b/\r\nX: y", None), (1, "u", ""), (9, "é", tricky),
            (7, "u", "é" * 5000), (8, "u", "x" * 3_000_000)]
    path, df = round_trip(spark, tmp_path, rows, records_per_file=3)
    got = {int(r.record_id[12:-1]): r for r in df.collect()}
    for i, (size, digest, kind, first) in plain.warc_rows([(r[0], r[2]) for r in rows]).items():
        assert got[i].payload_length == size and got[i].payload_digest == f"sha1:{digest}" and got[i].warc_type == kind
        assert got[i].refers_to == (None if first is None else f"<urn:x-page:{first}>")
    assert got[9].payload.decode() == tricky and got[4].payload is None and got[3].target_uri == "http://b/%0D%0AX: y"
    assert warc.read_warc(spark, path, payload=False).filter("payload IS NOT NULL").count() == 0


def test_header_predicates_are_pushed(spark, tmp_path):
    path, df = round_trip(spark, tmp_path, [(i, f"http://h{i % 3}/", "p" * (i % 5)) for i in range(40)])
    assert df.filter("warc_type = 'revisit'").count() == 35
    assert df.filter("target_uri LIKE 'http://h1%' AND warc_type IN ('response')").count() == len({i % 5 for i in range(5) if i % 3 == 1})
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    assert list(reader.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("offset",), 3)])) == [GreaterThan(("offset",), 3)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5


def test_min_bytes_repeats_null_ids_and_no_pages(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (3, "u", "abcd"), (None, "u", "abcd")]
    _, df = round_trip(spark, tmp_path, rows, min_bytes=3)
    assert sorted((r.record_id, r.warc_type) for r in df.collect()) == sorted(
        [("<urn:x-page:1>", "response"), ("<urn:x-page:2>", "response"), ("<urn:x-page:3>", "response"),
         ("<urn:x-page:3>", "response"), ("<urn:x-page:4>", "revisit"), ("<urn:x-page:>", "revisit")])
    empty = str(tmp_path / "none")
    warc.write_warc(spark.createDataFrame([], PAGES), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_gzipped_members_and_a_broken_file(spark, tmp_path):
    path, _ = round_trip(spark, tmp_path, [(1, "u", "abc")])
    record = b"".join(open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    zipped = tmp_path / "z.warc.gz"
    zipped.write_bytes(gzip.compress(record) * 2)
    assert [r.payload for r in warc.read_warc(spark, str(zipped)).collect()] == [b"abc", b"abc"]
    broken = tmp_path / "b.warc"
    broken.write_bytes(record[:-20])
    with pytest.raises(Exception, match="ends within|no record|no header"):
        warc.read_warc(spark, str(broken)).collect()


def test_token_counts_across_block_borders(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(0, 40, 60)]
    end = 9
    ids = np.concatenate([np.append(rng.integers(10, 60000, n), end) for n in lengths]).astype("<u2")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.bin").write_bytes(ids.tobytes() + np.array([77, 78], "<u2").tobytes())
    (tmp_path / "t" / "b.bin").write_bytes(np.full(5, end, "<u2").tobytes())
    (tmp_path / "t" / "c.bin").write_bytes(b"")
    (tmp_path / "t" / "d.bin").write_bytes(np.full(500, 5, "<u2").tobytes())
    for block in (38, 1 << 20):
        got = token_scan.token_counts(spark, str(tmp_path / "t"), end, block_bytes=block).collect()
        one = sorted((r for r in got if r.file.endswith("a.bin")), key=lambda r: r.place)
        assert [r.n_tokens for r in one] == [*lengths, 2] and [r.closed for r in one] == [True] * 60 + [False]
        assert [r.first_token for r in one] == list(np.cumsum([0, *[n + 1 for n in lengths]]))
        assert sorted((r.place, r.n_tokens) for r in got if r.file.endswith("b.bin")) == [(i, 0) for i in range(5)]
        assert [(r.n_tokens, r.closed) for r in got if r.file.endswith("d.bin")] == [(500, False)]
    (tmp_path / "e").mkdir()
    assert token_scan.token_counts(spark, str(tmp_path / "e"), end).count() == 0


def test_token_files_of_documents(spark, tmp_path, awkward):
    docs, rows = awkward
    placed = token_scan.write_tokens(docs, str(tmp_path / "f"), queries.TOKENIZER, queries.END_OF_DOCUMENT)
    counts = token_scan.token_counts(spark, str(tmp_path / "f"), queries.END_OF_DOCUMENT, block_bytes=50_000)
    encoding = token_scan.load_tokenizer(queries.TOKENIZER)
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(encoding.encode_ordinary(t or "")) for _, t in rows)
    assert placed.count() == len(rows)


def test_token_counts_land_on_their_documents(spark):
    encoding = token_scan.load_tokenizer(queries.TOKENIZER)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op3_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(encoding.encode_ordinary(t or "")) for i, t in text.items()}
    assert len(got) == len(text) and all(r.closed for r in got)


def test_tokens_of_shuffled_repeated_and_no_documents(spark, tmp_path, make_docs):
    rows = [(i, "word " * (i % 17), "s") for i in range(200)] + [(3, "word " * 3, "s"), (None, None, "s")]
    shuffled = make_docs(rows).repartition(7, "n_chars").withColumn("value", F.lit(1))
    assert token_scan.is_file_scan(spark.read.parquet(f"{SF}/documents.parquet").select("text")) and not token_scan.is_file_scan(shuffled)
    placed = token_scan.write_tokens(shuffled, str(tmp_path / "s"), queries.TOKENIZER, queries.END_OF_DOCUMENT)
    counts = token_scan.token_counts(spark, str(tmp_path / "s"), queries.END_OF_DOCUMENT, block_bytes=64)
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    joined = counts.select(part.alias("part"), "place", "n_tokens").join(placed, ["part", "place"]).collect()
    encoding = token_scan.load_tokenizer(queries.TOKENIZER)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in joined) == sorted((i or -1, len(encoding.encode_ordinary(t or ""))) for i, t, _ in rows)
    nothing = token_scan.write_tokens(make_docs([]), str(tmp_path / "e"), queries.TOKENIZER, queries.END_OF_DOCUMENT)
    assert nothing.count() == 0 and token_scan.token_counts(spark, str(tmp_path / "e"), queries.END_OF_DOCUMENT).count() == 0


VECTORS = "vec_id long, embedding array<float>, score int, part int"


def search(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], VECTORS)
    return {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), **settings).collect()}


def test_top_k_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(120)]  # ties
    expected = plain.top_k(rows)
    assert search(spark, rows) == expected
    assert search(spark, rows, shard_rows=64, block_rows=3) == expected


def test_top_k_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, -1.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (50, [inf, 1.0]), (5, []), (100, [0.0, 0.0]),
            (None, [1.0, 1.0])]
    assert search(spark, rows) == plain.top_k([rows[0], rows[1], rows[7]])
    assert search(spark, []) == set() and search(spark, [(0, [1.0])]) == set()


def test_top_k_of_mixed_lengths_and_repeated_queries(spark):
    rng = np.random.default_rng(7)
    pairs = [(i, [float(x) for x in rng.integers(-3, 4, 2)]) for i in range(120)]
    triples = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(150, 210)]
    assert search(spark, pairs + triples, shard_rows=16) == plain.top_k(pairs) | plain.top_k(triples)
    twice = spark.createDataFrame([(50, [1.0, 0.0], 1, 1), (50, [0.0, 1.0], 1, 1)], VECTORS)
    base = spark.createDataFrame([(*r, 1, 1) for r in pairs], VECTORS)
    got = sorted(tuple(r) for r in topk.top_k(base, twice, k=3).collect())
    want = []
    for q in ([1.0, 0.0], [0.0, 1.0]):
        want += [r for r in plain.top_k([(50, q), *[p for p in pairs if p[0] != 50]], 3) if r[0] == 50]
    assert got == sorted(want)


def test_top_k_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 20, (5000, 3)).astype(float)
    vectors[17] = 300
    lists = topk.SortedLists(np.arange(5000), vectors)
    assert lists.top(np.array([1.0, 2.0, 1.0]), 1, None)[0] == (1200, 17) and lists.reached < 200
