"""Best-fit packing of documents into training sequences under conflicts.

A sequence (bin) holds at most ``capacity`` words, at most one piece of each source and at most one of each cluster of
duplicates. Each bin carries two bitmaps, its sources and its clusters. Pieces come in order of falling size; the open
bins are kept by residual room, and the search goes up from the piece's size, residual by residual, until it meets a
bin without a conflict: the tightest compatible one. A residual also carries the sources that all its bins have, so
that it is passed over at once where every bin has a conflict.

Texts longer than a bin are cut into pieces of ``capacity`` words; no word is lost. Packing runs in shards of about
``shard_rows`` rows of a few numbers each, dealt by a digest of the id, so that its memory is bounded, a hot
source is spread over all shards, and a shard that is computed again gives the same bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.storage import sized_broadcast
from gaugesieve.llm.mixing import word_count
from gaugesieve.llm.ngram_join import JaccardJoin

PIECES = ("doc_id long, part int, first_word long, n_words long, source string, cluster long, shard int, "
          "bin int, bin_words long")


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []  # ascending, those with bins
        self.at: dict[int, list[int]] = {}  # residual: its bins, oldest first
        self.shared: dict[int, int] = {}  # residual: sources that all of its bins have
        self.sources: list[int] = []  # by bin, a bitmap
        self.clusters: list[int] = []
        self.room: list[int] = []

    def _settle(self, residual: int) -> None:
        bins = self.at[residual]
        if not bins:
            del self.at[residual], self.shared[residual]
            self.residuals.pop(bisect_left(self.residuals, residual))
            return
        common = -1
        for b in bins:
            common &= self.sources[b]
            if not common:
                break
        self.shared[residual] = common

    def _place(self, b: int, residual: int) -> None:
        self.room[b] = residual
        if residual not in self.at:
            insort(self.residuals, residual)
            self.at[residual], self.shared[residual] = [b], self.sources[b]
        else:
            insort(self.at[residual], b)
            self.shared[residual] &= self.sources[b]

    def put(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes the piece. ``source`` and ``cluster`` are bitmaps with one bit."""
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[i]
            if self.shared[residual] & source:
                continue
            for b in self.at[residual]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self.at[residual].remove(b)
                    self._settle(residual)
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    self._place(b, residual - size)
                    return b
        b = len(self.room)
        self.sources.append(source)
        self.clusters.append(cluster)
        self.room.append(0)
        self._place(b, self.capacity - size)
        return b


def packed_shard(capacity: int, pieces: pd.DataFrame) -> pd.DataFrame:
    """``pieces`` with their bins. Order: falling size, then id, part, source and cluster."""
    pieces = pieces.sort_values(["n_words", "doc_id", "part", "source", "cluster"], ascending=[False, True, True, True, True],
                                kind="stable", na_position="last").reset_index(drop=True)
    bit = {}
    bins = Bins(capacity)
    sources = [1 << bit.setdefault(s, len(bit)) for s in pieces["source"].fillna("\0")]
    seen = {}
    clusters = [1 << seen.setdefault(c, len(seen)) for c in pieces["cluster"]]
    pieces["bin"] = [bins.put(*x) for x in zip(pieces["n_words"].tolist(), sources, clusters)]
    pieces["bin"] = pieces["bin"].astype("int32")
    pieces["bin_words"] = pieces.groupby("bin")["n_words"].transform("sum")
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster_col: str | None = None, capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """One row per piece: (doc_id, part, first_word, n_words, source, cluster, shard, bin, bin_words).

    A bin is (shard, bin). Without ``cluster_col`` a cluster is the digest of the text lower-cased and with runs of
    spaces made one, so exact copies never meet; else the digest of that column. Texts without words, and null
    texts, have nothing to pack and give no row. Null sources are one source. Repeated rows are packed each.
    An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    cluster = F.xxhash64(plain) if cluster_col is None else F.xxhash64(F.col(f"`{cluster_col}`"))
    light = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                        cluster.alias("cluster"), word_count(text).alias("words"))
    return _packed(light, docs.count(), capacity, shard_rows)


def _packed(light: DataFrame, rows: int, capacity: int, shard_rows: int) -> DataFrame:
    """PIECES of the ``rows`` rows (doc_id, source, cluster, words); a long document's pieces are spread over the shards too."""
    if capacity < 1 or shard_rows < 1:
        raise ValueError("capacity and shard_rows must be positive")
    shards = max(1, -(-rows // shard_rows))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.lit(capacity)))
    pieces = light.filter("words > 0").withColumn("p", F.explode(parts)).select(
        "doc_id", F.col("p").cast("int").alias("part"), (F.col("p") * capacity).alias("first_word"),
        F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("p") * capacity).alias("n_words"), "source", "cluster",
        F.pmod(F.xxhash64("doc_id", "cluster", "p"), F.lit(shards)).cast("int").alias("shard"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return packed_shard(capacity, group)
    return pieces.groupBy("shard").applyInPandas(run, PIECES)


def pack_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """``pack`` with the classes of the Jaccard join, at five words and 0.8, as clusters: near copies never meet.

    Texts that are equal up to case and runs of spaces are one class, as in ``pack``. The join's pass over the texts counts
    their words too, so packing reads the stored sets and no text again.
    """
    low = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                      F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    join = JaccardJoin().fit(low, "id", "text", carry="source")
    linked = join.linked.select("node", "component")
    rows = join.sets.select(F.col("doc").alias("doc_id"), F.col("carried").alias("source"), "class", "words")
    clustered = rows.join(sized_broadcast(linked), F.col("class") == F.col("node"), "left").select(
        "doc_id", "source", F.coalesce("component", "class").alias("cluster"), "words")
    return _packed(clustered, join.sets.count(), capacity, shard_rows)
