"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into shards of bounded size and queries into blocks; every block meets every shard, as an exact
search over a stated query set must. A shard keeps, per dimension, its vectors sorted by that component. For a query
the lists are read from the end where the product is largest, a step of all lists at a time; vectors met for the
first time are scored in full. The sum of the products at the current places bounds the score of every vector
not met yet, and the search stops when the bound is below the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import stored
from gaugesieve.llm.batches import bounded_batches

PACK = "dims int, part long, ids binary, asks binary, ints binary"
FOUND = "query_id long, ask long, vec_id long, score long"
MOST_PARTITIONS = 10_000
FIRST_STEP = 16
EXACT = 2.0 ** 53


def scaled_ints(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _packed(rows: DataFrame) -> DataFrame:
    """(dims, part, id, ask, ints) to one row per length and part: ids, question numbers and components as binary."""
    def run(group: pa.Table) -> pa.Table:
        ints = group.column("ints").combine_chunks()

        def binary(numbers):
            return pa.array([numbers.to_numpy().astype(np.int64).tobytes()], pa.binary())
        return pa.table({"dims": group.column("dims")[:1].combine_chunks(), "part": group.column("part")[:1].combine_chunks(),
                         "ids": binary(group.column("id")), "asks": binary(group.column("ask")), "ints": binary(ints.flatten())})
    return rows.groupBy("dims", "part").applyInArrow(run, PACK)


class SortedLists:
    """The vectors of a shard and, per dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.reached = 0  # vectors scored by the last search

    def top(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), best first, ties to the smaller id; without the vectors whose id is ``own``."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.zeros(n, bool)
        best_scores, best_ids = np.empty(0, self.vectors.dtype), np.empty(0, np.int64)
        at, step = 0, FIRST_STEP
        while at < n:
            to = min(at + step, n)
            near = np.zeros(n, bool)
            if to == n:
                near[:] = True
            else:
                near[self.order[n - to:n - at, up]] = True
                near[self.order[at:to, down]] = True
            near &= ~met
            rows = np.flatnonzero(near)
            met |= near
            if len(rows):
                ids = self.ids[rows]
                scores = self.vectors[rows] @ query
                if own is not None:
                    keep = ids != own
                    ids, scores = ids[keep], scores[keep]
                if len(best_scores) >= k:
                    keep = scores >= best_scores[-1]
                    ids, scores = ids[keep], scores[keep]
                best_scores, best_ids = np.concatenate([best_scores, scores]), np.concatenate([best_ids, ids])
                order = np.lexsort((best_ids, -best_scores))[:k]
                best_scores, best_ids = best_scores[order], best_ids[order]
            if to == n or met.all():
                break
            bound = query[up] @ self.vectors[self.order[n - to, up], up] + query[down] @ self.vectors[self.order[to - 1, down], down]
            if len(best_scores) == k and bound < best_scores[-1]:
                break
            at, step = to, step * 2
        self.reached = int(met.sum())
        return [(int(s), int(i)) for s, i in zip(best_scores, best_ids)]


def _exact_type(a: np.ndarray, b: np.ndarray):
    """Doubles where every sum of products is exact in them, else 64-bit numbers; an error where those overflow."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return np.float64
    if largest < 2.0 ** 63:
        return np.int64
    raise OverflowError("inner products of these vectors exceed 64 bits")


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          scale: int = 256, skip_own: bool = True, shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the largest inner product, per row of ``queries``.

    Components are floor(scale * x); ties go to the smaller id. Vectors that are null or empty, or hold null or non-finite
    components, and rows with a null id take no part. Vectors are compared with those of their own length. ``skip_own`` leaves
    out candidates with the query's id. A row that repeats an id is a candidate of its own, and a query row that does is
    answered by itself, with ranks from 1. Fewer than k candidates give fewer rows; an empty table gives none. Other columns,
    whatever their names, are not read.

    A shard and all the blocks of queries that it meets go to one task, the shard first: it is sorted once, and the blocks
    stream by.
    """
    bounded_batches(vectors.sparkSession)

    def usable(rows: DataFrame) -> DataFrame:
        found = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled_ints(F.col(f"`{vec_col}`"), scale).alias("ints"))
        return found.filter("id IS NOT NULL AND ints IS NOT NULL").withColumn("dims", F.size("ints"))

    base = usable(vectors)
    parts = stored(base.groupBy("dims").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / F.lit(shard_rows))).alias("parts")), "parts")
    number = parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    place = F.pmod(F.xxhash64("id", "ints"), F.col("parts"))
    shards = _packed(base.join(F.broadcast(parts), "dims").select("dims", place.alias("part"), "id", F.lit(0).cast("long").alias("ask"), "ints"))
    asked = stored(usable(queries).withColumn("ask", F.monotonically_increasing_id()), "asked")
    blocks = max(1, -(-asked.count() // block_rows))
    asking = _packed(asked.select("dims", F.pmod(F.xxhash64("id", "ask"), F.lit(blocks)).alias("part"), "id", "ask", "ints"))
    meetings = asking.drop("part").join(F.broadcast(parts), "dims").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = ["dims", "part", "ids", "asks", "ints"]
    both = shards.select(F.lit(0).alias("kind"), *columns).unionByName(meetings.select(F.lit(1).alias("kind"), *columns))
    width = max(1, min(number, MOST_PARTITIONS))
    together = both.repartition(width, "dims", "part").sortWithinPartitions("dims", "part", "kind")

    def run(batches):
        lists, points, ids = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                mine = np.frombuffer(row["ints"], np.int64).reshape(-1, row["dims"])
                if row["kind"] == 0:
                    lists, points, ids = None, mine, np.frombuffer(row["ids"], np.int64)
                    continue
                kind = _exact_type(points, mine)
                if lists is None or lists.vectors.dtype != kind:
                    lists = SortedLists(ids, points.astype(kind))
                asks, out = np.frombuffer(row["asks"], np.int64), []
                for q, ask, point in zip(np.frombuffer(row["ids"], np.int64).tolist(), asks.tolist(), mine.astype(kind)):
                    out += [(q, ask, i, s) for s, i in lists.top(point, k, q if skip_own else None)]
                names = [f.split()[0] for f in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names)

    found = together.mapInArrow(run, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
