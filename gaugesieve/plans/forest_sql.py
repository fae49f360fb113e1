"""DuckDB text of the isolation forest: its samples, its trees level by level, and the walk of every row."""

from __future__ import annotations

from gaugesieve.operators.iforest import PRIME

DEPTH = 8  # of trees of 256 rows
PATH = ("CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n::DOUBLE WHEN n = 2 THEN 1 ELSE 0 END")


def forest_ctes(source: str, dims: int, trees: int = 200, seed: int = 42, size: int = 256, tag: str = "") -> list[tuple[str, str]]:
    """CTEs up to ``nodes<tag>``: the trees fitted on ``source``, a table (k, x) of keys and filled values."""
    t = tag
    below = f"ceil(least(1.0::DOUBLE, (1.5 * least({size}, (SELECT count(*) FROM {source})) + 64) / (SELECT count(*) FROM {source})) * {PRIME})"
    low, high = ("[" + ", ".join(f"{f}(x[{i + 1}])" for i in range(dims)) + "]" for f in ("min", "max"))
    ctes = [
        (f"dg{t}", f"SELECT x, md5(concat_ws('-', CAST(k AS VARCHAR), '{seed}')) AS h FROM {source}"),
        (f"dr{t}", f"""SELECT tree, x, h, (('0x' || substr(h, 1, 11))::BIGINT + tree * ('0x' || substr(h, 12, 11))::BIGINT) % {PRIME} AS draw
 FROM dg{t}, (SELECT unnest(range({trees})) AS tree)"""),
        (f"l{t}0", f"""SELECT tree, 0 AS node, x FROM dr{t} WHERE draw < {below}
 QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, h) <= {size}"""),
    ]
    for d in range(DEPTH + 1):
        ctes += [
            (f"s{t}{d}", f"SELECT tree, node, count(*) AS n, {low} AS lo, {high} AS hi FROM l{t}{d} GROUP BY tree, node"),
            (f"p{t}{d}", f"""SELECT *, md5(concat_ws('-', '{seed}', CAST(tree AS VARCHAR), CAST(node AS VARCHAR))) AS g,
 CASE WHEN n > 1 AND {d} < {DEPTH} THEN list_filter(range(1, {dims + 1}), lambda i: hi[i] > lo[i]) ELSE [] END AS sp FROM s{t}{d}"""),
            (f"f{t}{d}", f"""SELECT *, CASE WHEN len(sp) > 0 THEN sp[1 + ('0x' || substr(g, 1, 8))::BIGINT % len(sp)] END AS f,
 ('0x' || substr(g, 9, 13))::BIGINT / {16 ** 13}::DOUBLE AS share FROM p{t}{d}"""),
            (f"c{t}{d}", f"SELECT tree, node, f, lo[f] + share * (hi[f] - lo[f]) AS cut, CASE WHEN f IS NULL THEN {d} + {PATH} END AS path FROM f{t}{d}"),
        ]
        if d < DEPTH:
            ctes.append((f"l{t}{d + 1}", f"""SELECT tree, 2 * node + CASE WHEN x[f] <= cut THEN 1 ELSE 2 END AS node, x
 FROM l{t}{d} JOIN c{t}{d} USING (tree, node) WHERE f IS NOT NULL"""))
    ctes.append((f"nodes{t}", " UNION ALL ".join(f"SELECT * FROM c{t}{d}" for d in range(DEPTH + 1))))
    return [(name, text, name[0] in "lcn") for name, text in ctes]


def score_ctes(source: str, out: str, trees: int = 200, size: int = 256, fitted: str | None = None, tag: str = "") -> list[tuple[str, str]]:
    """CTEs up to ``out``, a table (k, score) of the rows (k, x) of ``source``; ``fitted`` is the table the trees come from."""
    t = tag
    steps = [(f"w{t}0", f"SELECT k, x, tree, 0 AS node FROM {source}, (SELECT unnest(range({trees})) AS tree)")]
    for d in range(DEPTH):
        steps.append((f"w{t}{d + 1}", f"""SELECT k, x, tree, CASE WHEN f IS NULL THEN node WHEN x[f] <= cut THEN 2 * node + 1
 ELSE 2 * node + 2 END AS node FROM w{t}{d} JOIN nodes{t} USING (tree, node)"""))
    whole = f"(SELECT {PATH} FROM (SELECT least({size}, count(*)) AS n FROM {fitted or source}))"
    steps.append((out, f"""SELECT k, pow(2e0, -avg(path) / {whole}) AS score FROM w{t}{DEPTH} JOIN nodes{t} USING (tree, node) GROUP BY k"""))
    return steps
