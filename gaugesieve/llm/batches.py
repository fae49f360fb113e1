"""Arrow batches of texts, taken a few rows at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ROWS: whole texts are far longer than the rows the default is for."""
    if not 0 < int(spark.conf.get(SETTING)) <= ROWS:
        spark.conf.set(SETTING, str(ROWS))


def small_batches(batches, text: int, rows: int = 256):
    """(slice, texts as bytes) of at most ``rows`` rows each; column ``text`` holds strings, null counts as empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(text).fill_null("").cast(pa.binary()).to_pylist()
