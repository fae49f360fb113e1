"""Compare a registered query with its SQL text run by DuckDB on the same files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(df, sql: str, con) -> list[str]:
    """Differences between the two results, empty when they agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns: spark {sorted(df.columns)} / sql {sorted(names)}"]
    order = sorted(names)
    at = [names.index(c) for c in order]
    theirs = [tuple(_cell(row[i]) for i in at) for row in result.fetchall()]
    ours = [tuple(_cell(v) for v in row) for row in df.select(*order).collect()]
    if len(ours) != len(theirs):
        problems.append(f"rows: spark {len(ours)} / sql {len(theirs)}")
    a, b = Counter(ours), Counter(theirs)
    if a != b:
        for label, extra in (("spark only", a - b), ("sql only", b - a)):
            rows = list(extra.items())
            problems.append(f"{label}: {sum(extra.values())} e.g. {rows[:2]}")
        problems.append(f"column order {order}")
    types = {c: type(v).__name__ for row in ours[:50] for c, v in zip(order, row) if v is not None}
    other = {c: type(v).__name__ for row in theirs[:50] for c, v in zip(order, row) if v is not None}
    if types != other and ours and theirs:
        problems.append(f"types: { {c: (types.get(c), other.get(c)) for c in order if types.get(c) != other.get(c)} }")
    return problems
