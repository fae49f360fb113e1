import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (id, text, source) rows, with columns whose names could clash."""
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, "x", 2, 3, 4.0) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS + ", n long, class string, size long, copies int, score double")
    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls, empty and blank texts, repeats, a long text, odd characters."""
    long = " ".join(f"wörd{i % 997} x{i}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two three", "b"), (5, "ONE  two\tthree", "b"),
            (6, long, "c"), (7, long.upper(), "c"), (8, "é" * 40, None), (9, "tie tie tie tie tie tie tie", "a"),
            (10, "tie tie tie tie tie tie", "a"), (11, "\U0001F600 " * 30, ""), (12, "a\x00b c\x0bd", "d")]
    return make_docs(rows), [(i, t) for i, t, _ in rows]
