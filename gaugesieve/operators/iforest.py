"""Isolation Forest (Liu, Ting and Zhou, 2008); a higher score is more anomalous.

Nothing is drawn from a generator: which rows a tree sees is a digest of the row and the tree, and which feature a node
splits on, and where, a digest of (seed, tree, node). The same rows give the same trees under any layout and in any engine.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.rowwise import finite, number
from gaugesieve.functions.scale import row_digest
from gaugesieve.operators.transforms import fit_medians

PRIME = 17592186044399  # the largest below 2^44
NODES = "tree int, node int, feature int, cut double, path double"


def average_path(n) -> np.ndarray:
    """Expected depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _drawn(seed: int, tree: int, node: int) -> tuple[int, float]:
    """A whole number and a number in [0, 1) that belong to the node."""
    digest = hashlib.md5(f"{seed}-{tree}-{node}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:21], 16) / 16 ** 13


def _grow(points: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple[int, int, float, float]]:
    """(node, feature, cut, path) rows, children of node i being 2i+1 and 2i+2; leaves cut nothing."""
    rows, pending = [], [(0, 0, points)]
    while pending:
        node, depth, part = pending.pop()
        low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(points.shape[1]),) * 2
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(splittable):
            rows.append((node, -1, 0.0, depth + float(average_path(len(part)))))
            continue
        pick, share = _drawn(seed, tree, node)
        feature = int(splittable[pick % len(splittable)])
        cut = float(low[feature] + share * (high[feature] - low[feature]))
        left = part[:, feature] <= cut
        rows.append((node, feature, cut, 0.0))
        pending += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]
    return rows


@dataclass
class IsolationForestModel:
    columns: list[str]
    fills: dict[str, float]
    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    sample_size: int
    threshold: float = 0.5

    @property
    def reached(self) -> np.ndarray:
        """Which places of the arrays are nodes: the root, and the children of every node that cuts."""
        found = np.zeros(self.feature.shape, bool)
        found[:, 0] = True
        inner = (self.feature.shape[1] - 1) // 2
        for node in range(inner):
            cuts = found[:, node] & (self.feature[:, node] >= 0)
            found[:, 2 * node + 1] = found[:, 2 * node + 2] = cuts
        return found

    def _complete(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trees with every leaf carried on down to the last level, where all ways end: below a leaf no value goes right."""
        feature, cut, path = self.feature.copy(), self.cut.copy(), self.path.copy()
        for node in range(2 ** depth - 1):
            leaf = feature[:, node] < 0
            cut[leaf, node], feature[leaf, node] = np.inf, 0
            feature[leaf, 2 * node + 1], path[leaf, 2 * node + 1] = -1, path[leaf, node]
        feature[feature < 0] = 0
        return feature, cut, path

    def score(self, df: DataFrame, out: str = "anomaly_score") -> DataFrame:
        """Add the score 2^(-E[path] / c(sample size))."""
        depth = int(math.log2(self.feature.shape[1] + 1)) - 1
        scale = float(average_path(self.sample_size)) or 1.0
        feature, cut, path = self._complete(depth)
        width = feature.shape[1]

        @F.pandas_udf("double")
        def anomaly(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="float64")
            points = np.stack(values.to_numpy())
            scores = np.empty(len(points))
            first = np.arange(feature.shape[0]) * width
            flat_feature, flat_cut, flat_path = feature.ravel(), cut.ravel(), path.ravel()
            for start in range(0, len(points), 256):  # a block and its nodes stay in the processor's cache
                block = points[start:start + 256]
                row, flat = np.arange(len(block))[:, None] * block.shape[1], block.ravel()
                # A node's place is first + node, and its children's first + 2 * node + 1 or + 2.
                at = np.repeat(first[None, :], len(block), 0)
                for _ in range(depth):
                    right = flat.take(flat_feature.take(at) + row) > flat_cut.take(at)
                    at += at
                    at += right
                    at += 1 - first
                scores[start:start + 256] = np.exp2(-flat_path.take(at).mean(axis=1) / scale)
            return pd.Series(scores)

        return df.withColumn(out, anomaly(F.array(*_filled(df, self.columns, self.fills))))

    def detect(self, df: DataFrame, name: str = "iforest") -> DataFrame:
        scored = self.score(df, f"{name}_score")
        return scored.withColumn(f"{name}_pred", (F.col(f"{name}_score") > self.threshold).cast("int"))


def _filled(df: DataFrame, columns, fills):
    return [F.coalesce(finite(number(df, c)), F.lit(float(fills[c] or 0.0))) for c in columns]


def fit_isolation_forest(df: DataFrame, columns, trees: int = 200, sample_size: int = 256,
                         seed: int = 42, missing: str = "median", keys=()) -> IsolationForestModel:
    """Grow ``trees`` trees, each from its own draw of ``sample_size`` rows without replacement.

    A row's draw for a tree comes from a digest of its ``keys``, or of all its columns where none are named: two numbers h
    and k of the digest give (h + tree * k) mod PRIME, so that one digest serves all trees.
    Rows below a tree's threshold, about half more than it needs, are its candidates and those with the smallest
    draws its sample; only candidates leave the scan. Rows equal in what is digested share their draws. Neither the candidates nor the
    trees (at most ``2 * sample_size`` nodes each) grow with the data. ``missing`` is ``median`` or ``zero``.
    """
    columns = list(columns)
    if missing not in ("median", "zero"):
        raise ValueError("missing must be 'median' or 'zero'")
    fills = fit_medians(df, columns) if missing == "median" else dict.fromkeys(columns, 0.0)
    rows = df.count()
    if rows == 0:
        raise ValueError("no rows to fit")
    size = min(sample_size, rows)
    below = math.ceil(min(1.0, (1.5 * size + 64) / rows) * PRIME)
    row = row_digest(keys or [c for c in df.columns], seed)
    points = df.select(F.array(*_filled(df, columns, fills)).alias("x"), row.alias("row")).withColumns(
        {"h": F.conv(F.substring("row", 1, 11), 16, 10).cast("long"), "k": F.conv(F.substring("row", 12, 11), 16, 10).cast("long")})

    def draw(tree):
        return F.pmod(F.col("h") + tree * F.col("k"), F.lit(PRIME))

    # Each row is tried for every tree in generated code; only candidates are written.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")))
    drawn = (
        points.withColumn("tree", every).withColumn("draw", draw(F.col("tree"))).filter(F.col("draw") < below)
        .withColumn("place", F.row_number().over(W.partitionBy("tree").orderBy("draw", "row", "x")))
        .filter(F.col("place") <= size)
    )
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        part = part.sort_values("place")
        nodes = _grow(np.stack(part["x"].to_numpy()), seed, tree, limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "path"])

    nodes = drawn.select("tree", "place", "x").groupBy("tree").applyInPandas(grow, NODES).toPandas()
    width = 2 ** (limit + 1) - 1
    feature = np.full((trees, width), -1, dtype=np.int64)
    cut, path = np.zeros((trees, width)), np.zeros((trees, width))
    where = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature[where], cut[where], path[where] = nodes["feature"], nodes["cut"], nodes["path"]
    return IsolationForestModel(columns, fills, feature, cut, path, size)


def with_fold_anomaly(train: DataFrame, other: DataFrame, columns, out: str = "isolation_forest_score",
                      trees: int = 200, missing: str = "zero", seed: int = 42, keys=()):
    """Score both frames with a forest that has seen the first one only."""
    model = fit_isolation_forest(train, columns, trees=trees, missing=missing, seed=seed, keys=keys)
    return model.score(train, out), model.score(other, out)
