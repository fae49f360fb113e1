"""Web archives: a Spark writer of WARC files and a Python data source that reads them.

Writing uses Spark's own text writer, so files appear by its commit protocol on any file system it knows: a record is
one value, and the two line ends that close a WARC record are the line separator. Of pages with equal payloads one
is a response record, the others are revisit records without payload.

Reading plans files into partitions of about ``partition_bytes``. Within a file, headers come first: predicates on
record type and header fields are pushed down and decided before the block is touched, and the block of a record
that is not wanted, or whose payload is not asked for, is skipped by its length.
"""

from __future__ import annotations

import gzip
import io
import posixpath

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from gaugesieve.functions.storage import sized_broadcast, stored

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

SCHEMA = ("warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
          "content_length long, payload_length long, payload binary, file string, offset long")
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base32 without padding: each five hexadecimal digits are four base32 digits."""
    hexadecimal = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE_32, RFC_DIGITS)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (id, url, payload) with ``digest`` and ``first``: the smallest id with an equal payload, null for responses.

    Payloads below ``min_bytes`` are not compared. Null payloads are empty. A row with a null id never is the first;
    rows that repeat the first row's id and payload are responses too.
    """
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    rows = pages.select("id", "url", payload.alias("payload")).withColumn("digest", sha1_base32(F.col("payload")))
    key = F.col("id").cast("long")
    firsts = rows.filter(F.octet_length("payload") >= min_bytes).groupBy(F.col("digest").alias("of")).agg(
        F.min(key).alias("least"), F.count("*").alias("n"))
    firsts = stored(firsts.filter("n > 1 AND least IS NOT NULL").drop("n"), "firsts")
    joined = rows.join(sized_broadcast(firsts), F.col("digest") == F.col("of"), "left")
    return joined.withColumn("first", F.when(~key.eqNullSafe(F.col("least")), F.col("least"))).drop("of", "least")


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record per row as the text column ``value``, without the two line ends that close it.

    The block is an HTTP response; that of a revisit ends after the HTTP header, which states the length of the
    payload. Line ends in a url are percent-encoded; a null url gives a record without target. Null payloads are empty. Repeated
    rows give a record each, an empty table none. Other columns, whatever their names, are not read.
    """
    rows = with_revisits(pages.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (url_col, "url"), (payload_col, "payload"))]), min_bytes)
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    url = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))

    def line(label: str, value) -> Column:
        return F.coalesce(F.concat(F.lit(f"\r\n{label}: "), value), F.lit(""))

    return rows.select(F.concat(
        F.lit(VERSION), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), name, F.lit(">"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.col("first").cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block).alias("value"))


def write_warc(pages: DataFrame, path: str, records_per_file: int = 50_000, **settings) -> None:
    """Write ``pages`` as WARC files into the new folder ``path``."""
    warc_records(pages, **settings).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


class WarcError(ValueError):
    """A file that does not follow the format, with file and place."""


def file_system(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and
                                        not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _header(stream, version: bytes) -> dict[str, str]:
    """The fields of a header whose first line is ``version``; names in lower case, later lines joined."""
    fields, last = {}, None
    for line in iter(stream.readline, b""):
        text = line.rstrip(b"\r\n")
        if not text:
            return fields
        if text[:1] in b" \t" and last:
            fields[last] += " " + text.strip().decode("utf-8", "replace")
            continue
        name, colon, value = text.partition(b":")
        if not colon:
            raise WarcError(f"no header field: {text[:60]!r}")
        last = name.strip().lower().decode("utf-8", "replace")
        fields[last] = value.strip().decode("utf-8", "replace")
    raise WarcError("the file ends within a header")


class Chunk(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Keep what headers can decide; Spark applies the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append(("in", column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append(("in", column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append(("starts", column, (f.value,)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append(("given", column, ()))
            else:
                yield f

    def partitions(self):
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not posixpath.basename(f.path).startswith(("_", ".")))
        chunks, size = [], self.partition_bytes
        for name, length in files:
            if not chunks or size and size + length > self.partition_bytes:
                chunks.append([])
                size = 0
            chunks[-1].append(name)
            size += length
        return [Chunk(c) for c in chunks] or [Chunk([])]

    def _passes(self, fields: dict[str, str]) -> bool:
        for kind, column, values in self.wanted:
            value = fields.get(HEADERS[column])
            if value is None or kind == "in" and value not in values or kind == "starts" and not value.startswith(values):
                return False
        return True

    def _records(self, system, name: str):
        with system.open_input_file(name) as raw:
            zipped = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            buffered = io.BufferedReader(raw, 1 << 20)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=buffered), 1 << 20) if zipped else buffered
            while True:
                at = stream.tell()
                line = stream.readline()
                if not line:
                    return
                if line in (b"\r\n", b"\n"):
                    continue
                if not line.startswith(b"WARC/"):
                    raise WarcError(f"{name}, byte {at}: no record starts here")
                try:
                    fields = _header(stream, line)
                    length = int(fields["content-length"])
                except (WarcError, KeyError, ValueError) as e:
                    raise WarcError(f"{name}, byte {at}: {e}") from e
                start = stream.tell()
                if self._passes(fields):
                    yield at, fields, length, self._block(stream, fields, length)
                if stream.tell() != start + length:
                    stream.seek(start + length)

    def _block(self, stream, fields: dict[str, str], length: int):
        """(length of the payload, payload or None); HTTP headers are no part of it."""
        start = stream.tell()
        stated = length
        if fields.get("content-type", "").startswith("application/http") and length:
            stream.readline()
            http = _header(stream, b"")
            stated = length - (stream.tell() - start)
            if fields.get("warc-type") == "revisit":
                return int(http.get("content-length", stated)), None
        if not self.payload:
            return stated, None
        data = stream.read(stated)
        if len(data) < stated:
            raise WarcError("the file ends within a block")
        return stated, data

    def read(self, partition):
        schema = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                            ("content_length", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary()),
                            ("file", pa.string()), ("offset", pa.int64())])
        system, _ = file_system(self.path)
        rows, size = [], 0
        for name in partition.value:
            for at, fields, length, (stated, data) in self._records(system, name):
                rows.append((*[fields.get(h) for h in HEADERS.values()], length, stated, data, name, at))
                size += 400 + len(data or b"")
                if size > 8 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class WarcDataSource(DataSource):
    """Format ``warc``. Options: path, payload (read payloads, default true), partition_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 32 << 20) -> DataFrame:
    """The records of a WARC file or folder, plain or gzipped; header predicates on it are pushed down.

    ``payload`` of revisits, and of all records where ``payload`` is false, is null; ``payload_length`` is always
    known. A folder without files has no rows. Turns on the session's filter pushdown to Python sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option(
        "partition_bytes", partition_bytes).load()
