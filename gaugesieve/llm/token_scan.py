"""Token counts of documents in flat token files that have no index.

A flat file is nothing but token ids of fixed width, each document closed by the end-of-document id. Blocks of such
files are read by byte range, so a file of any size is scanned by many tasks. A block finds its separators with one
vector comparison. The document that reaches into a block began after the last separator of the blocks before it:
a running maximum over the blocks of the file, the prefix scan, supplies that place, and lengths are
differences of separator places.

``write_tokens`` makes such files: ids of a public tokenizer, written by Spark's text writer with the separator as line end.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import sized_broadcast, stored
from gaugesieve.llm.batches import bounded_batches, small_batches
from gaugesieve.llm.warc import file_system

# Fixed value: the pattern that the public byte-level vocabularies expect texts to be split by.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCKS = "file string, block long, first long, tokens long, ends array<long>"


def load_tokenizer(path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def is_file_scan(rows: DataFrame) -> bool:
    """Whether the rows come straight from files, whose splits and order are the same whenever they are read."""
    plan = rows._jdf.queryExecution().optimizedPlan()
    return bool(rows.inputFiles()) and plan.collectLeaves().size() == 1 and not any(
        word in plan.toString() for word in ("Repartition", "Aggregate", "Sort", "Join", "Sample", "Limit", "Window", "Generate"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, separator: int, id_col: str = "doc_id",
                 text_col: str = "text", width: int = 2) -> DataFrame:
    """Write the token ids of ``docs`` as flat files into the new folder ``path``.

    ``tokenizer`` names a rank file that exists on every machine; it never yields ``separator``. ``width`` is the
    bytes per id, little endian. Returns where each document went, (doc_id, part, place): the number of its file and its place
    in it. The rows are read twice in the same order, so a table that is not a plain scan of files is stored first. Null and
    empty texts have no tokens but a separator of their own; repeated rows are documents each; an empty table has no
    documents. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if not is_file_scan(docs):
        docs = stored(docs, "documents")
    kind = f"<u{width}"

    def run(batches):
        encoding = load_tokenizer(tokenizer)
        for _, texts in small_batches(batches, 0):
            out = []
            for text in texts:
                ids = np.asarray(encoding.encode_ordinary(text.decode("utf-8")), np.int64)
                if (ids == separator).any() or ids.max(initial=0) >= 1 << 8 * width:
                    raise ValueError("an id of the tokenizer is the separator or too wide")
                out.append(ids.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    line_end = int(separator).to_bytes(width, "little").decode("latin-1")
    ids = docs.select("text").mapInArrow(run, "value binary")
    ids.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", line_end).text(path)
    place = F.monotonically_increasing_id()
    return docs.select(F.col("id").alias("doc_id"), F.shiftright(place, 33).alias("part"),
                       place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


class Range(InputPartition):
    def __init__(self, file: str, block: int, start: int, size: int):
        super().__init__((file, block, start, size))


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.width = int(options.get("width", 2))
        self.separator = int(options["separator"])
        per_block = int(options.get("block_bytes", 8 << 20))
        self.block_bytes = max(self.width, per_block - per_block % self.width)

    def partitions(self):
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
        ranges = []
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if f.size % self.width:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole number of ids")
            ranges += [Range(f.path, i, start, min(self.block_bytes, f.size - start))
                       for i, start in enumerate(range(0, f.size, self.block_bytes))]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition):
        file, block, start, size = partition.value
        if not size:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(file) as f:
            f.seek(start)
            ids = np.frombuffer(f.read(size), f"<u{self.width}")
        first = start // self.width
        ends = np.flatnonzero(ids == self.separator) + first
        yield pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))],
            ["file", "block", "first", "tokens", "ends"])


class TokenBlocks(DataSource):
    """Format ``token_blocks``. Options: path, separator, width, block_bytes."""

    @classmethod
    def name(cls):
        return "token_blocks"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return BlockReader(dict(self.options))


def token_counts(spark: SparkSession, path: str, separator: int, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """(file, place, first_token, n_tokens, closed) per document of the flat files under ``path``.

    ``place`` numbers the documents of a file from 0. Tokens after the last separator are one more document that is
    not closed. A file of separators only has documents of no tokens; an empty file or folder has no documents.
    """
    spark.dataSource.register(TokenBlocks)
    blocks = spark.read.format("token_blocks").option("path", path).option("separator", separator).option(
        "width", width).option("block_bytes", block_bytes).load()
    blocks = stored(blocks, "blocks")
    # The scan over the blocks of a file carries three numbers of each; the separators stay where they are.
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.array_max("ends").alias("end"), F.size("ends").alias("n")).select(
        F.col("file").alias("of_file"), F.col("block").alias("of_block"), F.coalesce(F.max("end").over(before), F.lit(-1)).alias("last_end"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.lead("block").over(order).isNull().alias("is_last"))
    same = (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block"))
    scanned = blocks.join(sized_broadcast(stored(offsets, "offsets")), same).select(
        "file", "block", "ends", (F.col("first") + F.col("tokens")).alias("upto"), "last_end", "docs_before", "is_last")
    inner = F.transform("ends", lambda e, i: F.struct(
        (F.col("docs_before") + i).alias("place"),
        (F.when(i == 0, F.col("last_end")).otherwise(F.get("ends", i - 1)) + 1).alias("first_token"), e.alias("end")))
    closed = scanned.select("file", F.inline(inner)).select(
        "file", "place", "first_token", (F.col("end") - F.col("first_token")).alias("n_tokens"), F.lit(True).alias("closed"))
    last_end = F.coalesce(F.array_max("ends"), F.col("last_end"))
    tail = scanned.filter("is_last").select(
        "file", (F.col("docs_before") + F.size("ends")).alias("place"), (last_end + 1).alias("first_token"),
        (F.col("upto") - last_end - 1).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.unionByName(tail)
