"""Quality of whole texts by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage becomes a vector of surface features: shares of byte
classes, word lengths, repetition within the passage and against earlier ones, and hashed words. An encoder makes
it a representation, gated attention weighs the passages of a document, and the weighted representation is scored.
Encoder, attention and score are learned together from document labels only.

Training collects the passage features of at most ``max_documents`` labelled documents with at most ``max_passages`` passages
together, those first by a digest of the id, and runs on the driver. Scoring is a function of one text and the fitted numbers, so any task can do it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import stored
from gaugesieve.llm.batches import bounded_batches, small_batches
from gaugesieve.llm.hashing import BLOCK, SPACES, WordHasher

PASSAGE = 64
SINGLE = b".,!?*#$%&|-_/@=\"':;<>()\n"  # bytes that are a class of their own
WORD_BUCKETS = 64
OTHERS = ("lower", "upper", "digit", "space", "non-ascii", "control or other")
CLASSES = len(SINGLE) + len(OTHERS)
FEATURES = CLASSES + 5 + WORD_BUCKETS


def _classes() -> np.ndarray:
    found = np.full(256, len(SINGLE) + 5, np.int64)
    found[ord("a"):ord("z") + 1] = len(SINGLE)
    found[ord("A"):ord("Z") + 1] = len(SINGLE) + 1
    found[ord("0"):ord("9") + 1] = len(SINGLE) + 2
    found[list(SPACES)] = len(SINGLE) + 3
    found[0x80:] = len(SINGLE) + 4
    for i, b in enumerate(SINGLE):
        found[b] = i
    return found


class PassageEncoder:
    """Surface features of all passages of a text."""

    def __init__(self):
        self.hasher, self.classes = WordHasher(), _classes()

    def features(self, text: bytes) -> np.ndarray:
        """(passages, FEATURES); one row of zeros for a text without words."""
        parts, at, seen = [], 0, np.empty(0, np.uint64)
        while at < len(text):
            end = min(at + BLOCK, len(text))
            while end < len(text) and text[end] not in SPACES:
                end += 1
            rows, words = self._block(text[at:end], seen)
            if len(rows):
                parts.append(rows)
                if end < len(text):
                    seen = np.union1d(seen, words)
            at = end
        return np.concatenate(parts) if parts else np.zeros((1, FEATURES), np.float32)

    def _block(self, data: bytes, seen: np.ndarray):
        words, starts, ends = self.hasher.block(data)
        n = len(words)
        if not n:
            return np.empty((0, FEATURES), np.float32), words
        passage = np.arange(n) // PASSAGE
        count = int(passage[-1]) + 1
        size = np.bincount(passage, minlength=count).astype(float)
        bounds = np.append(starts[::PASSAGE], len(data))
        bounds[0] = 0
        length = np.diff(bounds).astype(float)
        of_byte = np.repeat(np.arange(count) * CLASSES, np.diff(bounds))
        codes = np.frombuffer(data, np.uint8)
        shares = np.bincount(of_byte + self.classes[codes], minlength=count * CLASSES).reshape(count, CLASSES) / length[:, None]
        word_length = (ends - starts).astype(float)
        mean = np.bincount(passage, word_length, count) / size
        spread = np.sqrt(np.maximum(np.bincount(passage, word_length ** 2, count) / size - mean ** 2, 0))
        distinct = np.bincount(_first_in_passage(passage, words), minlength=count) / size
        first = np.zeros(n, bool)
        first[np.unique(words, return_index=True)[1]] = True
        again = ~first | (np.isin(words, seen) if len(seen) else False)
        repeated = np.bincount(passage, again, count) / size
        buckets = np.bincount(passage * WORD_BUCKETS + (words % np.uint64(WORD_BUCKETS)).astype(np.int64),
                              minlength=count * WORD_BUCKETS).reshape(count, WORD_BUCKETS) / size[:, None]
        extra = np.stack([np.log1p(mean), np.log1p(spread), distinct, repeated, np.log1p(size)], 1)
        return np.concatenate([np.sqrt(shares), extra, buckets], 1).astype(np.float32), words


def _first_in_passage(passage: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Passage of the first of equal words in each passage."""
    order = np.lexsort((words, passage))
    p, w = passage[order], words[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
    return p[new]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Gated attention over encoded passages. ``prior`` is the score where there was nothing to learn from."""

    weights: dict | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.5

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 per bag of passage features, rounded to six places."""
        if self.weights is None:
            return np.full(len(bags), self.prior)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(int)
        logits = _forward(self.weights, (np.concatenate(bags) - self.mean) / self.scale, first)[0]
        return np.round(_sigmoid(logits).astype(float), 6)


def _forward(w: dict, x: np.ndarray, first: np.ndarray):
    """Logit per bag, and what the backward pass needs. ``first`` is the first passage of each bag."""
    sizes = np.diff(np.append(first, len(x)))
    bag = np.repeat(np.arange(len(first)), sizes)
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"] + w["vb"]), _sigmoid(h @ w["U"] + w["ub"])
    e = (v * u) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    attention = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(h * attention[:, None], first, axis=0)
    return z @ w["c"] + w["d"][0], (bag, h, v, u, attention, z)


def _gradients(w: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> dict:
    logits, (bag, h, v, u, attention, z) = _forward(w, x, first)
    delta = (_sigmoid(logits) - y) / len(y)
    g = {"c": z.T @ delta, "d": np.array([delta.sum()])}
    dz = np.outer(delta, w["c"])[bag]
    dh = dz * attention[:, None]
    da = (dz * h).sum(1)
    de = attention * (da - np.add.reduceat(da * attention, first)[bag])
    g["a"] = (v * u).T @ de
    dv, du = np.outer(de, w["a"]) * u * (1 - v * v), np.outer(de, w["a"]) * v * u * (1 - u)
    g["V"], g["vb"], g["U"], g["ub"] = h.T @ dv, dv.sum(0), h.T @ du, du.sum(0)
    dh = (dh + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return {k: g[k] + decay * w[k] for k in w}


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 40,
                  batch: int = 64, rate: float = 4e-3, decay: float = 3e-5, seed: int = 5) -> AttentionModel:
    """Fit by Adam on bags in a seeded order. Labels of one kind, or none, give a model that scores their smoothed mean."""
    labels = np.asarray(labels, float)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return AttentionModel(None, prior=float(prior))
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [((b - mean) / scale).astype(np.float64) for b in bags]
    rng = np.random.default_rng(seed)

    def start(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    w = {"W": start(every.shape[1], hidden), "b": np.zeros(hidden), "V": start(hidden, gates), "vb": np.zeros(gates),
         "U": start(hidden, gates), "ub": np.zeros(gates), "a": start(gates), "c": start(hidden),
         "d": np.array([np.log(prior / (1 - prior))])}
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])[:-1]]).astype(int)
            g = _gradients(w, np.concatenate([bags[i] for i in chosen]), first, labels[chosen], decay)
            t += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - pace * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
    return AttentionModel(w, mean, scale)


def held_out(key: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_documents: int = 6000, max_passages: int = 200_000, **settings) -> AttentionModel:
    """A model from the labelled rows that are not held out.

    Null labels and ids are left out; an id with several labels has their majority, 1 on a tie. Of the labelled ids
    the ``max_documents`` first by a digest are used, and of their documents those whose passages, summed in that order, do
    not exceed ``max_passages``: this bounds what the driver collects, however long the texts are. Null texts count as empty,
    repeated rows each count, and other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    key = F.col(f"`{id_col}`").cast("long")
    known = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter(
        "id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = stored(known.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(max_documents), "labelled")
    texts = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        encoder = PassageEncoder()
        for batch, texts in small_batches(batches, 2):
            for i, y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                features = encoder.features(raw).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([len(features)], pa.int64()),
                     pa.array([features.tobytes()], pa.binary())], ["id", "y", "n", "features"])

    # The chosen rows are at most ``max_documents``, so they can be broadcast.
    encoded = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(run, "id long, y int, n long, features binary")
    encoded = stored(encoded, "passages")
    # A window over a few numbers of at most ``max_documents`` ids.
    order = W.orderBy(F.xxhash64(F.lit(3), "id"), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = encoded.groupBy("id").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
    few = sizes.filter(F.col("upto") <= max_passages).select("id")
    rows = sorted(encoded.join(F.broadcast(few), "id").collect(), key=lambda r: (r["id"], bytes(r["features"])))
    bags = [np.frombuffer(r["features"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return fit_attention(bags, np.array([r["y"] for r in rows]), **settings)


def quality_score(model: AttentionModel, text: Column) -> Column:
    """Probability of label 1 for each text; null texts count as empty. Call ``bounded_batches`` before it runs."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        encoder, out, bags, size = PassageEncoder(), [], [], 0
        for t in texts:
            bags.append(encoder.features((t or "").encode()))
            size += len(bags[-1])
            if size >= 20_000:
                out.append(model.score(bags))
                bags, size = [], 0
        if bags:
            out.append(model.score(bags))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; repeated rows give a row each, null texts score as empty ones.

    An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    found = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), quality_score(model, F.col(f"`{text_col}`")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
