"""The registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugesieve.functions.storage import new_path
from gaugesieve.llm import (
    conversation_repair, filter_audit, imatch, licenses, mixing, ngram_join, packing, quality, secret_scan, token_scan, topk,
    toxicity, warc,
)

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files and read back: responses with their payload, revisits by header only."""
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    full = warc.read_warc(spark, path).filter("warc_type = 'response'").select(
        "record_id", "warc_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.sha1_base32(F.col("payload")).alias("payload_digest"))
    light = warc.read_warc(spark, path, payload=False).filter("warc_type = 'revisit'").select(
        "record_id", "warc_type", "refers_to", F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"))

    def page(name: str):
        return F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")

    return full.unionByName(light).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"))


ORACLE_OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hexadecimal FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hexadecimal) AS first_id FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(hexadecimal, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


ORACLE_OP2 = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files, scanned again: tokens per document."""
    path = new_path(spark, "tokens")
    placed = token_scan.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER, END_OF_DOCUMENT)
    counts = token_scan.token_counts(spark, path, END_OF_DOCUMENT)
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    found = counts.withColumn("of_part", part).withColumnRenamed("place", "of_place")
    return found.join(placed, (F.col("of_part") == F.col("part")) & (F.col("of_place") == F.col("place"))).select(
        "doc_id", "n_tokens", "part", "place", "first_token", "closed")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the attention model; held-out rows never trained it."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.imatch(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin; near copies are in different bins."""
    return packing.pack_near(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's shingle set, the class that links put it in, and its number of links."""
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove under all their orders, per language."""
    return filter_audit.audit_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN known ON known.doc_id = w.doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter,
  1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
  coalesce(list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''),
    lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)), 0)::INTEGER AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
r AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN b ELSE 0 END) AS toxic_lost
  FROM cells, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a seed, with their faults, cheapest repair and its digest."""
    damage = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_conversations(damage).withColumnRenamed("conv", "conv_id")



def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the factorization machine; held-out rows never trained it."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_top_k, op3_token_counts, op4_mixing, op5_quality, op6_imatch, op7_secrets, op8_licenses, op9_best_fit,
    op10_jaccard_join, op11_filter_audit, op12_conversation_repair, op13_toxicity)}
ORACLE_SQL = {"op1_warc": ORACLE_OP1, "op2_top_k": ORACLE_OP2, "op11_filter_audit": ORACLE_OP11}
