"""License notices in whole texts: a positional index of rare template words.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Templates are whole license texts and
standard notices, and the base phrases, each with its mandatory key phrases; the postings list the places of every word
in every template. The vocabulary of the templates is counted over all documents. In a document

1. a template is possible if the document has all words of its key phrases;
2. of the template's words in the document, the ``rare`` ones of highest inverse document frequency are looked up: each place of
   such a word, minus its place in the template, is a relative position, and positions that several rare words agree on,
   give or take a drift of an eighth of the template, are a candidate;
3. a candidate counts if every mandatory key phrase stands within it, found by the phrase's own rarest word;
4. all template words in the candidate's window vote for (place in the template, place in the text), and the longest chain ascending
   in both, as a share of the template's words, is the score.

A base phrase is a template without drift whose key is the whole phrase. Of overlapping notices the best stays. Each step walks
lists of places in order, so the time grows with the text, however many notices it has.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugesieve.llm.batches import bounded_batches, small_batches
from gaugesieve.llm.license_texts import TEMPLATES

# Phrases that are a notice by themselves, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

FOUND = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
         "score double, spans array<struct<label:string,first:long,last:long,score:double>>")


def _word_bytes() -> bytes:
    """Translation of a byte to itself if it belongs to a word, lower-cased, else to a space."""
    letters = b"0123456789abcdefghijklmnopqrstuvwxyz"
    return bytes(b + 32 if 65 <= b <= 90 else b if b in letters or b >= 0x80 else 0x20 for b in range(256))


WORDS = _word_bytes()


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORDS).split()


class Index:
    """Template postings, key phrases and base phrases."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels, self.texts, self.keys = [], [], []
        for label, forms in templates.items():
            for text, keys in forms:
                self.labels.append(label)
                self.texts.append(text.encode().split())
                self.keys.append([k.encode().split() for k in keys])
        self.places = [defaultdict(list) for _ in self.texts]  # by template: word to its places
        for text, places in zip(self.texts, self.places):
            for place, word in enumerate(text):
                places[word].append(place)
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.needed = [frozenset(w for k in keys for w in k) for keys in self.keys]  # without these words no template
        self.phrase_words = [frozenset(p) for p, _ in self.phrases]
        self.vocabulary = frozenset().union(*self.places, *self.phrase_words)

    def lookup(self, words: list[bytes], idf: dict[bytes, float]) -> "Lookup | None":
        """The places of vocabulary words in a document that may have a template or phrase, else None."""
        present = self.vocabulary.intersection(words)
        possible = [t for t, needed in enumerate(self.needed) if needed <= present]
        phrases = [i for i, needed in enumerate(self.phrase_words) if needed <= present]
        return Lookup(self, words, idf, present, possible, phrases) if possible or phrases else None


class Lookup:
    """One document against the index."""

    def __init__(self, index: Index, words: list[bytes], idf: dict[bytes, float], present: set, possible: list[int], phrases: list[int]):
        self.index, self.words, self.idf, self.present, self.possible, self.phrases = index, words, idf, present, possible, phrases
        wanted = set().union(*(index.phrase_words[i] for i in phrases), *(index.places[t] for t in possible))
        self.at = defaultdict(list)
        for place, word in enumerate(words):
            if word in wanted:
                self.at[word].append(place)

    def rarest(self, words, count: int) -> list[bytes]:
        """The ``count`` words of highest inverse document frequency among those of the document."""
        return sorted(self.present.intersection(words), key=lambda w: (-self.idf[w], w))[:count]

    def starts(self, phrase: list[bytes]) -> list[int]:
        """Ascending places where the phrase stands, by the places of its rarest word."""
        word = self.rarest(phrase, 1)[0]
        within = phrase.index(word)
        return [p - within for p in self.at[word] if p >= within and self.words[p - within:p - within + len(phrase)] == phrase]

    def base(self) -> list[tuple[int, str]]:
        """(first word, label) of every place of every base phrase; places may overlap."""
        return sorted((start, self.index.phrases[i][1]) for i in self.phrases for start in self.starts(self.index.phrases[i][0]))

    def notices(self, rare: int, slack: int, least: float) -> list[tuple[str, int, int, float]]:
        """(label, first, last, score) of the candidates that count, the best of those that overlap."""
        found = []
        for t in self.possible:
            found += self._of_template(t, rare, max(slack, len(self.index.texts[t]) // 8), least)
        best = []
        for label, first, last, score in sorted(found, key=lambda h: (-h[3] * (h[2] - h[1]), h[1] - h[2], h[1], h[0])):
            # Those taken are disjoint, so only the neighbours can overlap.
            at = bisect_left(best, (first,))
            if (at == 0 or best[at - 1][1] <= first) and (at == len(best) or last <= best[at][0]):
                insort(best, (first, last, label, score))
        return [(label, first, last, score) for first, last, label, score in best]

    def _of_template(self, t: int, rare: int, drift: int, least: float):
        text, places = self.index.texts[t], self.index.places[t]
        votes = Counter()
        chosen = self.rarest(places, rare)
        for word in chosen:
            for place in self.at[word]:
                for at in places[word]:
                    votes[place - at] += 1
        offsets = sorted(votes)
        needed = min(2, len(chosen))
        keys = None
        upto, near, taken = 0, 0, -math.inf
        for i, offset in enumerate(offsets):
            while upto < len(offsets) and offsets[upto] <= offset + drift:
                near += votes[offsets[upto]]
                upto += 1
            agreeing = near
            near -= votes[offset]
            if offset <= taken or agreeing < needed:
                continue
            if keys is None:
                keys = [(self.starts(k), len(k)) for k in self.index.keys[t]]
                if not all(starts for starts, _ in keys):
                    return
            first, last = max(0, offset), min(len(self.words), offset + drift + len(text))
            if not all(self._within(starts, size, first, last) for starts, size in keys):
                continue
            chain = self._chain(t, first, last, offset, drift)
            if len(chain) >= least * len(text):
                yield self.index.labels[t], chain[0], chain[-1] + 1, len(chain) / len(text)
                taken = chain[-1]

    @staticmethod
    def _within(starts: list[int], size: int, first: int, last: int) -> bool:
        at = bisect_left(starts, first)
        return at < len(starts) and starts[at] + size <= last

    def _chain(self, t: int, first: int, last: int, offset: int, drift: int) -> list[int]:
        """Places of the longest chain of template words in the window that ascends in the text and in the template."""
        places = self.index.places[t]
        ends, ends_at, before = [], [], {}
        for p in range(first, last):
            for i in reversed(places.get(self.words[p], ())):
                if 0 <= p - i - offset <= drift:
                    at = bisect_left(ends, i)
                    before[p, i] = ends_at[at - 1] if at else None
                    ends[at:at + 1], ends_at[at:at + 1] = [i], [(p, i)]
        chain, step = [], ends_at[-1] if ends_at else None
        while step is not None:
            chain.append(step[0])
            step = before[step]
        return chain[::-1]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that have each template word. The driver gets one row per such word."""
    def run(batches):
        index = Index()
        counts, rows = Counter(), 0
        for _, texts in small_batches(batches, 0):
            for raw in texts:
                counts.update(index.vocabulary.intersection(words_of(raw)))
                rows += 1
        counts[b""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         ["word", "n"])

    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    counts = {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.pop(b"", 0), counts


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 12, slack: int = 2,
                  least: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: places of the phrases, labels, score and the aligned notices.

    ``n_base`` counts all places of all phrases, ``first_word`` and ``last_word`` are their smallest and largest start,
    null without one. ``labels`` joins the labels of phrases and of notices; ``score`` is 1 where a phrase stands, else
    that of the best notice, else 0. Null and empty texts have no words. Repeated rows give a row each. An empty table gives an
    empty result. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    total, counts = document_frequencies(docs, text_col)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in Index().vocabulary}

    def run(batches):
        index = Index()
        for batch, texts in small_batches(batches, 1):
            rows = []
            for raw in texts:
                words = words_of(raw)
                found = index.lookup(words, idf)
                base, hits = (found.base(), found.notices(rare, slack, least)) if found else ([], [])
                own = {label for _, label in base}
                score = 1.0 if base else max((h[3] for h in hits), default=0.0)
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                             ",".join(sorted(own)), ",".join(sorted(own | {h[0] for h in hits})), score,
                             [dict(zip(("label", "first", "last", "score"), h)) for h in hits]))
            columns = list(zip(*rows)) or [[]] * 8
            span = pa.struct({"label": pa.string(), "first": pa.int64(), "last": pa.int64(), "score": pa.float64()})
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             [f.split()[0] for f in FOUND.split(", ")])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, FOUND)
