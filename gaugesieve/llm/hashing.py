"""Words and word shingles of whole texts as 64-bit hashes, computed on byte arrays without a loop over words.

A word is a run of bytes other than the six ASCII spaces, with A-Z lower-cased. Its hash is a
polynomial over per-byte random values, finished by a bit mixer. Everything is a function of the
text alone, so any task, retry or rerun gives the same numbers. Two different shingles share a
hash with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; 0 for spaces, the same for both cases of a letter."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    values[list(SPACES)] = 0
    return values


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes the words of byte strings; keeps the powers it needs between calls."""

    def __init__(self):
        self.values = _byte_values()
        self.power = np.ones(1, np.uint64)
        self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, BLOCK)
            for name, base in (("power", int(BASE)), ("back", _inverse(int(BASE)))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of every word of ``data``."""
        codes = self.values[np.frombuffer(data, np.uint8)]
        inside = codes != 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint64), starts, ends
        self._powers(len(data))
        codes *= self.power[:len(data)]
        sums = np.add.reduceat(codes, starts)
        sums *= self.back[starts]
        return mixed(sums ^ (ends - starts).astype(np.uint64)), starts, ends

    def words(self, text: bytes) -> np.ndarray:
        """Hashes of all words of one text, block by block; a block ends at a space."""
        if len(text) <= BLOCK:
            return self.block(text)[0]
        parts, at = [], 0
        while at < len(text):
            end = min(at + BLOCK, len(text))
            while end < len(text) and text[end] not in SPACES:
                end += 1
            parts.append(self.block(text[at:end])[0])
            at = end
        return np.concatenate(parts)

    def texts(self, texts: list[bytes]):
        """(word hashes of all texts, first word of each text and the total): texts are joined into blocks."""
        hashes, counts, waiting, size = [], [], [], 0

        def flush():
            nonlocal waiting, size
            if waiting:
                lengths = np.array([len(t) + 1 for t in waiting])
                found, starts, _ = self.block(b" ".join(waiting))
                bounds = np.searchsorted(starts, np.cumsum(lengths))
                counts.append(np.diff(bounds, prepend=0))
                hashes.append(found)
                waiting, size = [], 0

        for text in texts:
            if len(text) > BLOCK:
                flush()
                found = self.words(text)
                hashes.append(found)
                counts.append(np.array([len(found)]))
                continue
            if size + len(text) >= BLOCK:
                flush()
            waiting.append(text)
            size += len(text) + 1
        flush()
        if not counts:
            return np.empty(0, np.uint64), np.zeros(1, np.int64)
        return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole text where it has fewer."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    total = words[:n - k + 1].copy()
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(1, k):
            factor = factor * STEP
            total += words[i:n - k + 1 + i] * factor
        return np.unique(mixed(total + np.uint64(k)))
