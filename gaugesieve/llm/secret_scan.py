"""Secrets in whole texts: fixed patterns, and strings that a battery of randomness tests cannot tell from noise.

The battery takes every run of key characters without the fixed patterns in it, cut at ``=`` unless that is padding at
the end. A run that no alphabet covers is split at ``/ + - _`` into the longest pieces that one covers; these may overlap.
For what has at least ``min_length`` characters it infers the encoding from the characters, and tests the null hypothesis
"these symbols are random" three ways: chi-squared for a uniform use of the alphabet, Wald and Wolfowitz's runs above and
below the middle of it, and lag-one serial correlation. What one of them rejects is ordinary.

The others look random, but a short word may do so too. The opposite null hypothesis, "this is ordinary writing", gives each a
second p-value: ordinary strings are made of digit pairs and of letter pairs that are common in prose, and other pairs (rare letters,
a letter beside a digit, a capital after a small letter) have a share of ODD in them at most; the p-value is the probability of so many odd
pairs. Secrets are discovered against this null per length class, with the rule of Benjamini and Hochberg over all tested strings of the corpus,
so that of the reports of a class at most a share ``rate`` should be ordinary strings. Long strings have many pairs and pass easily; a class of
short ones needs more evidence each. A number has no odd pair and is never reported. The p-values
of a class are counted in bins, so the corpus sends one small row per bin to the driver and nothing per document.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.storage import stored
from gaugesieve.llm.batches import bounded_batches

# The patterns of the three base kinds, and the order of kinds at one start.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = (b"passw", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Encodings by characters, the narrowest first; a string has the first that covers it.
ALPHABETS = (
    ("decimal", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
INDEX = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS}
LENGTH_CLASSES = (24, 32, 48, 80)  # first lengths of the second class and those after it
# Pairs of letters that are common in English, German, French or Spanish.
PAIRS = frozenset((
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce "
    "li ch ll be ma si om ur ei ie un sc ge au ht ss ke qu ai ue eu us os la ci ad do ta ca rt em et ns el il no so di ac tr")
    .split())
ODD = 0.4  # share of odd pairs in ordinary strings, at most
RANDOM = 0.01  # a string is not random if one of the three tests, corrected for their number, is below this
BINS = 64  # bins of -log10(p), a quarter each; the last takes all that is smaller

FOUND = ("n_chars long, base array<struct<kind:int,first:int,last:int>>, "
         "tested array<struct<first:int,last:int,size:int,bin:int>>")


def encoding_of(string: str) -> str | None:
    """Name of the narrowest alphabet that has all characters of ``string``, ``=`` at its end aside."""
    used = set(string.rstrip("="))
    return next((name for name, index in INDEX.items() if used and used <= index.keys()), None)


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(x: float, freedom: int) -> float:
    """Upper tail by the cube root transformation."""
    if x <= 0:
        return 1.0
    spread = 2 / (9 * freedom)
    return 0.5 * math.erfc(((x / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(spread) / math.sqrt(2))


@functools.cache
def _upper_tail(k: int, n: int) -> float:
    """Probability of at least k odd pairs of n in an ordinary string."""
    return min(1.0, sum(math.comb(n, i) * ODD**i * (1 - ODD) ** (n - i) for i in range(k, n + 1))) if k else 1.0


def ordinary_p(string: str) -> float:
    """Probability of so many odd pairs in ordinary writing; a long string's by its first 400 pairs that tell most."""
    string = string.rstrip("=")
    odd = sum(not (a.isdigit() and b.isdigit() or (a + b).lower() in PAIRS and (b.islower() or a.isupper()))
              for a, b in zip(string, string[1:]))
    pairs = len(string) - 1
    if pairs > 400:  # the same share of 400 pairs; below 1e-16 in any case
        odd, pairs = odd * 400 // pairs, 400
    return _upper_tail(odd, pairs)


def randomness_p(string: str, encoding: str) -> float:
    """Probability of symbols at least as uneven, ordered or correlated as these, were they random."""
    index = INDEX[encoding]
    symbols = [index[c] for c in string.rstrip("=")]
    n, size = len(symbols), len(index)
    groups = max(2, min(size, n // 5))
    counts, expected = [0] * groups, [0] * groups
    for s in symbols:
        counts[s * groups // size] += 1
    for s in range(size):
        expected[s * groups // size] += n / size
    uniform = _chi_squared_tail(sum((c - e) ** 2 / e for c, e in zip(counts, expected)), groups - 1)
    high = [2 * s >= size for s in symbols]
    above = sum(high)
    below = n - above
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 1 + 2 * above * below / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs_p = _normal_two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 2.0 ** (1 - n)
    centre = sum(symbols) / n
    power = sum((s - centre) ** 2 for s in symbols)
    serial = sum((a - centre) * (b - centre) for a, b in zip(symbols, symbols[1:])) / power if power else 1.0
    serial_p = _normal_two_sided((serial + 1 / n) * math.sqrt(n))
    return min(1.0, 3 * min(uniform, runs_p, serial_p))


def _runs(member: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end) of the runs of at least ``least`` bytes that are members."""
    runs = np.flatnonzero(np.diff(member, prepend=False, append=False)).reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, ascending by start, with those that overlap made one."""
    found = []
    for first, last in spans:
        if found and first < found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], last))
        else:
            found.append((first, last))
    return found


def pieces_of(string: str) -> list[tuple[int, int]]:
    """Start and end of the longest pieces of a run of key characters that one alphabet covers, padding included.

    ``=`` ends a piece, and belongs to it at the end of the run only.
    """
    found = []
    body = len(string.rstrip("="))
    for part in re.finditer(r"[^=]+", string[:body]):
        first, last = part.span()
        padded = len(string) if last == body else last
        if encoding_of(part[0]):
            found.append((first, padded))
            continue
        by_cut = [[m.span() for m in re.finditer(cut, part[0])] for cut in (r"[^-_]+", r"[^+/]+")]
        spans = [span for spans, others in (by_cut, by_cut[::-1]) for span in spans if not _inside(span, others)]
        found += [(first + a, padded if first + b == last else first + b) for a, b in sorted(set(spans))]
    return found


def _inside(span: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    """Whether one of the ascending, disjoint ``others`` is larger than the span and covers it."""
    at = bisect_right(others, (span[0], math.inf)) - 1
    return at >= 0 and others[at] != span and others[at][1] >= span[1]


def beside(first: int, last: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the ascending ``spans`` leave of first to last."""
    left = []
    for a, b in spans:
        if b > first and a < last:
            if a > first:
                left.append((first, a))
            first = max(first, b)
    return left + [(first, last)] if first < last else left


class Scanner:
    def __init__(self, min_length: int):
        self.min_length = min_length
        codes = np.zeros((2, 256), bool)
        codes[0, list(b"0123456789abcdef")] = True
        codes[1, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=")] = True
        self.hexadecimal, self.key = codes

    def scan(self, raw: bytes):
        """(number of characters, base spans, tested spans) of one text in UTF-8; places are in characters."""
        codes = np.frombuffer(raw, np.uint8)
        text = None
        later = np.flatnonzero(codes & 0xC0 == 0x80)  # bytes that continue a character
        n = len(codes) - len(later)

        def places(runs: np.ndarray) -> list:
            return (runs - np.searchsorted(later, runs)).tolist()

        base = []
        low = raw.lower()
        if any(name in low for name in NAMES):
            text = raw.decode("utf-8")
            base += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if b"AKIA" in raw:
            text = text if text is not None else raw.decode("utf-8")
            base += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        base += [(2, a, b) for a, b in places(_runs(self.hexadecimal[codes], LEAST["hex"]))]
        base.sort(key=lambda s: (s[1], s[0]))
        taken = united([s[1:] for s in base])
        ends = [e for _, e in taken]
        tested = []
        keys = _runs(self.key[codes], self.min_length)
        for (a, b), (start, stop) in zip(keys.tolist(), places(keys)):
            string = raw[a:b].decode("ascii")
            near, at = [], bisect_right(ends, start)
            while at < len(taken) and taken[at][0] < stop:
                near.append((taken[at][0] - start, taken[at][1] - start))
                at += 1
            for left, right in beside(0, b - a, near):
                for x, y in pieces_of(string[left:right]):
                    piece = string[left + x:left + y]
                    if len(piece.rstrip("=")) < self.min_length:
                        continue
                    bin_ = 0
                    if randomness_p(piece, encoding_of(piece)) >= RANDOM:
                        bin_ = min(BINS - 1, int(-4 * math.log10(max(ordinary_p(piece), 1e-300))))
                    first = start + left + x
                    tested.append((first, first + len(piece), sum(len(piece) >= c for c in LENGTH_CLASSES), bin_))
        return n, base, tested


def without_spans(text: str, spans, mark: str) -> str:
    """``text`` with the ascending ``spans`` replaced by ``mark``; spans that overlap or touch become one mark."""
    parts, at = [], 0
    for i, (first, last) in enumerate(spans):
        if i == 0 or first > at:
            parts += [text[at:first], mark]
        at = max(at, last)
    return "".join(parts) + text[at:]


def discovery_bins(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Per length class the first bin whose strings are reported, BINS for none; bins hold falling p-values.

    A bin counts with its largest p-value, so the rule errs to the side of reporting less.
    """
    found = {}
    for size in {s for s, _ in counts}:
        total = sum(n for (s, _), n in counts.items() if s == size)
        upto, first = 0, BINS
        for b in range(BINS - 1, 0, -1):
            upto += counts.get((size, b), 0)
            if upto and 10 ** (-b / 4) <= rate * upto / total:
                first = b
        found[size] = first
    return found


def scanned_column(text: Column, min_length: int) -> Column:
    """What ``Scanner.scan`` finds in each text, null as empty, as a struct of FOUND. Call ``bounded_batches`` before it runs."""
    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        scanner = Scanner(min_length)
        found = [scanner.scan((t or "").encode()) for t in texts]
        return pd.DataFrame({"n_chars": [f[0] for f in found],
                             "base": [[dict(zip(("kind", "first", "last"), s)) for s in f[1]] for f in found],
                             "tested": [[dict(zip(("first", "last", "size", "bin"), s)) for s in f[2]] for f in found]})

    return scan(F.coalesce(text.cast("string"), F.lit("")))


def _reported(discovered: dict[int, int]) -> Column:
    """The spans of ``base`` and the discovered ones of ``tested``."""
    random = F.filter("tested", lambda t: t["bin"] >= _first_bin(t["size"], discovered))
    return F.concat("base", F.transform(random, lambda t: F.struct(
        F.lit(KINDS.index("random")).alias("kind"), t["first"].alias("first"), t["last"].alias("last"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 16,
                 rate: float = 0.05) -> DataFrame:
    """(doc_id, n_chars, n_assign, n_access, n_hex, base, spans) per row of ``docs``.

    ``base`` has the spans of the fixed patterns as kind:start:end, by start and then kind, joined by commas; ``spans``
    has the random strings too. Starts and ends count characters, the end is exclusive. Null and empty texts have no
    spans. Repeated rows give a row each. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    scanned = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), scanned_column(F.col(f"`{text_col}`"), min_length).alias(
        "found")).select("doc_id", "found.*"), "secrets")
    spans = _reported(_discovered(scanned, rate))

    def listed(array):
        by_start = F.array_sort(F.transform(array, lambda s: F.struct(s["first"].alias("first"), s["kind"].alias("kind"), s["last"].alias("last"))))
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.concat_ws(",", F.transform(by_start, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"], s["last"])))

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", "n_chars", counted("assign"), counted("access"), counted("hex"),
                          listed(F.col("base")).alias("base"), listed(spans).alias("spans"))


def _discovered(scanned: DataFrame, rate: float) -> dict[int, int]:
    """First reported bin per length class; one row per class and bin comes to the driver."""
    bins = scanned.select(F.inline("tested")).groupBy("size", "bin").agg(F.count("*").alias("n")).collect()
    return discovery_bins({(r["size"], r["bin"]): r["n"] for r in bins}, rate)


def _first_bin(size, discovered: dict[int, int]):
    column = F.lit(BINS)
    for s, b in sorted(discovered.items()):
        column = F.when(size == s, F.lit(b)).otherwise(column)
    return column


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", mark: str = "[SECRET]",
             min_length: int = 16, rate: float = 0.05) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all rows stay, and ``count_col``, if given, counts the new text.

    Overlapping and touching spans become one mark. Null texts stay null. Repeated rows stay, an empty table stays empty, and
    columns of any name are kept. Texts are scanned once: the rows are stored with their spans, and only those that have some
    are rewritten.
    """
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scanned = stored(docs.select(row, scanned_column(F.col(f"`{text_col}`"), min_length).alias("found")).select("row", "found.*"), "scanned")
    spans = F.array_sort(F.transform(_reported(_discovered(scanned, rate)), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    cut = scanned.select("row", spans.alias("spans"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(s["first"], s["last"]) for s in found], mark) for t, found in zip(texts, spans)], dtype=object)

    text = F.col("row")[text_col].cast("string")
    dirty = cut.filter((F.size("spans") > 0) & text.isNotNull()).withColumn("text", clean(text, F.col("spans")))
    plain = cut.filter((F.size("spans") == 0) | text.isNull()).withColumn("text", text)
    both = plain.unionByName(dirty)
    new = {text_col: F.col("text")} | ({count_col: F.length("text").cast("long")} if count_col is not None else {})
    fields = [new.get(c, F.col("row")[c]).alias(c) for c in dict.fromkeys([*docs.columns, *new])]
    return both.select(*fields)
