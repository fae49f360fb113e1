"""Results that outlive the executors that made them: files in the folder all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A session on one machine may go without the setting: a temporary folder is then set for it.
    On a cluster executors could not read each other's local files, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="gaugesieve-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


COMPRESSION = "zstd"  # unlike the default it also shortens digests, which stand as text
# The paths of the innermost scope and the scope around it.
_scope: ContextVar[tuple | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """A scope that deletes, at its end, the tables that operators have stored within it.

    Write or collect what shall last inside the scope, to a place of its own: results are lazy and read the stored tables.
    Scopes may nest; tables stored by other threads than the one that opened the scope stay. ``outlasting`` stores what shall
    belong to the scope around this one.
    """
    paths: list[str] = []
    token = _scope.set((paths, _scope.get()))
    try:
        yield
    finally:
        _scope.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            where = hadoop(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    if (scope := _scope.get()) is not None:
        scope[0].append(path)
    return path


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, sizes are known."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def outlasting(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` stored for longer than the innermost ``scratch`` scope: until the end of the one around it, if there is one."""
    scope = _scope.get()
    token = _scope.set(scope[1] if scope is not None else None)
    try:
        return stored(df, name)
    finally:
        _scope.reset(token)


def durable(df: DataFrame) -> DataFrame:
    """Store ``df`` now and cut its lineage: compressed columns, of which a reader takes what it needs, not a checkpoint's whole rows."""
    return stored(df, "durable")


def sized_broadcast(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table`` of a few numbers per row, to be broadcast if it has at most BROADCAST_ROWS rows, else as it is.

    ``table`` should be stored: its rows are counted unless ``rows`` is given.
    """
    return F.broadcast(table) if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table
