"""A corpus pipeline: each stage reads what its predecessor kept and writes what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugesieve.functions.storage import stored
from gaugesieve.llm import mixing, ngram_join, packing, quality, secret_scan

THRESHOLD = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores below the threshold go.

    Null texts score as empty ones. Rows that repeat stay or go alike. Without labels of both kinds all documents have one
    score, the smoothed mean of the labels. Columns of any name are kept; an empty table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.quality_score(model, docs["text"]) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id.

    Null, empty and blank texts are copies of nothing and stay. Of rows that repeat id and text one stays; rows with a null id
    count as smaller than any. Columns of any name are kept; an empty table stays empty.
    """
    return ngram_join.one_per_class(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts are replaced by a mark, and ``n_chars`` counts the new text.

    Null texts stay null, repeated rows stay, columns of any name are kept, and an empty table stays empty.
    """
    return secret_scan.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as the mix of sources takes them.

    A null source is a source; null and empty texts have no words and are taken with their source's whole repetitions. Rows
    that repeat are taken alike. Columns of any name are kept; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: every piece of every document with its bin.

    Texts without words, and null texts, have no piece. Rows that repeat are packed each, in different bins. Other columns
    are not read; an empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit),
]

# The classifier and the seeded choices have no counterpart in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
