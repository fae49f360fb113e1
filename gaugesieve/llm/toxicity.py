"""Toxicity of whole texts by a factorization machine over hashed terms.

A term is a word (letters, digits and characters beyond ASCII, A-Z lower-cased) or the first 4 or 5 characters of a longer
word, which inflected insults share; it stands as a 64-bit hash. A document is the set of its terms. The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where x_i is the share of documents without the term: each term has a weight of its own, and each pair of terms the
product of their factors, so that an insult together with a mention of a group can count although neither does by itself.

Training sees at most ``max_documents`` labelled documents, half of them of each label where there are enough, those
first by a digest of the id; their losses are weighted back to the shares of the labels. Spark counts the documents per
term and label. The vocabulary are the ``telling`` terms that tell the labels apart best, if their likelihood ratio reaches
LEAST_RATIO, and the ``frequent`` most frequent others, which may matter in pairs only. The driver gets the vocabulary and one
bit per chosen document and term, at most max_documents * (telling + frequent) / 8 bytes however long the texts are, and fits by Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.storage import stored
from gaugesieve.llm.batches import bounded_batches, small_batches
from gaugesieve.llm.hashing import BLOCK, SPACES, WordHasher, mixed
from gaugesieve.llm.quality import held_out

PREFIXES = (4, 5)
LEAST_DOCUMENTS = 3
LEAST_RATIO = 12.0  # a term without any bearing on the label exceeds it once in about 2,000


class TermHasher(WordHasher):
    """Distinct term hashes of byte strings."""

    def __init__(self):
        super().__init__()
        letters = np.zeros(256, bool)
        letters[0x80:] = True
        for first, last in ("09", "AZ", "az"):
            letters[ord(first):ord(last) + 1] = True
        self.values[~letters] = 0

    def terms(self, data: bytes, known: np.ndarray | None = None) -> np.ndarray:
        """Sorted distinct terms of a text; only those among the sorted ``known`` if given. Long texts go block by block."""
        parts, at = [], 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and data[end] not in SPACES:
                end += 1
            found = self._block_terms(data[at:end])
            parts.append(found if known is None else found[among(known, found)[1]])
            at = end
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))

    def _block_terms(self, data: bytes) -> np.ndarray:
        words, starts, ends = self.block(data)
        if not len(words):
            return words
        found = [words]
        codes = np.frombuffer(data, np.uint8)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[codes] * self.power[:len(data)])])
        firsts = np.flatnonzero(codes & 0xC0 != 0x80)  # bytes that begin a character
        place = np.searchsorted(firsts, starts)
        firsts = np.append(firsts, np.full(max(PREFIXES) + 1, len(data)))
        for n in PREFIXES:
            stop = firsts[np.minimum(place + n, len(firsts) - 1)]
            longer = stop < ends
            a, b = starts[longer], stop[longer]
            found.append(mixed(((sums[b] - sums[a]) * self.back[a]) ^ np.uint64(n << 40)))
        return np.unique(np.concatenate(found))


def among(known: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``found`` its place in the sorted ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return place, known[place] == found


@dataclass
class FactorizationMachine:
    """``terms`` are sorted hashes, ``x`` their values, ``factors`` a row per term. Without terms all texts score ``prior``."""

    terms: np.ndarray
    x: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 per set of distinct terms, rounded to six places."""
        sizes = [len(b) for b in bags]
        place, there = among(self.terms, np.concatenate([np.empty(0, np.uint64), *bags]))
        bag, place = np.repeat(np.arange(len(bags)), sizes)[there], place[there]
        x = self.x[place]
        linear = np.bincount(bag, x * self.weights[place], len(bags))
        pairs = np.zeros(len(bags))
        for v in self.factors.T:
            each = x * v[place]
            pairs += np.bincount(bag, each, len(bags)) ** 2 - np.bincount(bag, each ** 2, len(bags))
        return np.round(1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30))), 6)


def fit_machine(terms: np.ndarray, bits: np.ndarray, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, rank: int = 6,
                epochs: int = 30, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Fit by Adam on packed bit rows, a column per term, in a seeded order. ``weights`` weigh the rows' losses."""
    labels, weights = np.asarray(labels, float), np.asarray(weights, float)
    share = (weights @ labels + 1) / (weights.sum() + 2)
    bias = np.log(share / (1 - share))
    n = len(terms)
    if not n or len(np.unique(labels)) < 2:
        return FactorizationMachine(terms[:0], x[:0], float(bias), np.empty(0), np.empty((0, rank)))
    rng = np.random.default_rng(seed)
    p = {"b": np.array([bias], np.float32), "w": np.zeros(n, np.float32), "v": rng.normal(0, 0.02, (n, rank)).astype(np.float32)}
    m, s = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    x = x.astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            here = np.unpackbits(bits[rows], axis=1, count=n) * x
            sums = here @ p["v"]
            logits = p["b"][0] + here @ p["w"] + ((sums ** 2).sum(1) - (here ** 2 @ p["v"] ** 2).sum(1)) / 2
            delta = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[rows]) * weights[rows] / len(rows)).astype(np.float32)
            g = {"b": np.array([delta.sum()], np.float32), "w": delta @ here + decay * p["w"],
                 "v": here.T @ (delta[:, None] * sums) - p["v"] * (delta @ here ** 2)[:, None] + decay * p["v"]}
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return FactorizationMachine(terms, x, float(p["b"][0]), p["w"], p["v"])


def _term_counts(batches):
    """(term, documents, those with label 1) of each slice of rows (y, text)."""
    hasher = TermHasher()
    for batch, texts in small_batches(batches, 1):
        found = [hasher.terms(t) for t in texts]
        each, at = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_inverse=True)
        labels = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(each.view(np.int64)), pa.array(np.bincount(at, minlength=len(each))),
             pa.array(np.bincount(at, labels, minlength=len(each)).astype(np.int64))], ["term", "n", "ones"])


def _likelihood_ratio(n: Column, ones: Column, all_rows: int, all_ones: int) -> Column:
    """How far the label depends on the term, twice the logarithm of the likelihood ratio."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = F.lit(all_ones / max(1, all_rows))
    rest, rest_ones = all_rows - n, all_ones - ones
    return 2 * (part(ones, n * share) + part(n - ones, n * (1 - share)) + part(rest_ones, rest * share)
                + part(rest - rest_ones, rest * (1 - share)))


def choose_rows(labels: DataFrame, id_col: str, label_col: str, max_documents: int) -> tuple[DataFrame, dict[int, float]]:
    """(id, y) of the rows to learn from, at most ``max_documents``, and the weight of each label.

    Null labels and ids and held-out ids are left out; an id with several labels has their majority, 1 on a tie.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter(
        "id IS NOT NULL AND y IS NOT NULL")
    known = stored(known.filter(~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")), "known")
    there = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    few = min(there.values(), default=0)
    room = {y: max(max_documents // 2, max_documents - few) for y in there}  # what the rarer label leaves goes to the other
    digest = F.xxhash64(F.lit(13), "id")
    parts = [known.filter(F.col("y") == y).orderBy(digest, "id").limit(room[y]) for y in sorted(there)]
    chosen = parts[0] if parts else known
    for more in parts[1:]:
        chosen = chosen.unionByName(more)
    taken = {y: min(there[y], room[y]) for y in there}
    weights = {y: there[y] / taken[y] * sum(taken.values()) / sum(there.values()) for y in there}
    return stored(chosen, "chosen"), weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_documents: int = 6000, telling: int = 2048, frequent: int = 512, **settings) -> FactorizationMachine:
    """A machine from the labelled rows that are not held out; see the module's text for its bounds.

    Null texts count as empty; repeated rows of a chosen id each count. Without rows of both labels, or without terms, the
    machine scores the smoothed share of label 1.
    """
    bounded_batches(docs.sparkSession)
    chosen, weights = choose_rows(labels, id_col, label_col, max_documents)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # The chosen rows are at most ``max_documents``, so they can be broadcast.
    sample = stored(source.join(F.broadcast(chosen), "id").select("y", F.coalesce("text", F.lit("")).alias("text"), "id"), "sample")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    counts = sample.select("y", "text").mapInArrow(_term_counts, "term long, n long, ones long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones")).filter(F.col("n") >= LEAST_DOCUMENTS)
    counts = stored(counts.withColumn("ratio", _likelihood_ratio(F.col("n"), F.col("ones"), totals["n"], totals["ones"])), "terms")
    kept = {r["term"]: r["n"] for r in counts.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(telling).collect()}
    most = len(kept) + frequent
    for r in counts.orderBy(F.desc("n"), "term").limit(most).collect():
        if len(kept) < most:
            kept.setdefault(r["term"], r["n"])
    terms = np.array(list(kept), np.int64).view(np.uint64)
    order = np.argsort(terms)
    terms, x = terms[order], 1 - np.array(list(kept.values()), float)[order] / max(1, totals["n"])

    def bits(batches):
        hasher = TermHasher()
        for batch, texts in small_batches(batches, 1):
            rows = np.zeros((len(texts), len(terms)), bool)
            for row, text in zip(rows, texts):
                row[np.searchsorted(terms, hasher.terms(text, terms))] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in np.packbits(rows, axis=1)], pa.binary())],
                                             ["y", "bits"])

    rows = sorted((r["y"], bytes(r["bits"])) for r in sample.select("y", "text").mapInArrow(bits, "y int, bits binary").collect())
    packed = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -(-len(terms) // 8))
    y = np.array([y for y, _ in rows], int)
    return fit_machine(terms, packed, x, y, np.array([weights[i] for i in y.tolist()]), **settings)


def toxicity_score(machine: FactorizationMachine, text: Column) -> Column:
    """Probability of label 1 for each text; null texts count as empty. Call ``bounded_batches`` before it runs."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        hasher, out = TermHasher(), []
        for at in range(0, len(texts), 64):
            out.append(machine.score([hasher.terms(t.encode(), machine.terms) for t in texts.iloc[at:at + 64]]))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; repeated rows give a row each, null texts score as empty ones.

    An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    found = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), toxicity_score(machine, F.col(f"`{text_col}`")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
