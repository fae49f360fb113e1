import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugesieve.functions import scale
from gaugesieve.functions.stats import correlation_p_value

rng = np.random.default_rng(3)
SHAPES = {
    "normal": rng.normal(size=2000), "ties": rng.integers(0, 5, 2000).astype(float),
    "third_equal": np.where(rng.random(2000) < 0.34, 3.25, rng.normal(size=2000)),
    "heavy_tail": rng.standard_cauchy(2000) ** 3, "constant": np.full(50, 2.0), "single": np.array([4.0]),
    "infinite": np.concatenate([rng.normal(size=500), [np.inf, -np.inf]]),
}
PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("shape", SHAPES)
def test_exact_quantiles_match_numpy(spark, shape):
    x = SHAPES[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
    got = {r.prob: r.quantile for r in scale.exact_quantiles(df, {"x": F.col("x")}, PROBS).collect()}
    # numpy interpolates between equal infinities and gets NaN at the two ends.
    want = {p: float(np.percentile(x, 100 * p)) for p in PROBS} | {0.0: float(x.min()), 1.0: float(x.max())}
    assert got == pytest.approx(want)
    assert scale.collect_quantiles(df, {"x": F.col("x")}, PROBS)["x"] == pytest.approx(got)


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_do_not_depend_on_how_often_an_interval_is_cut(spark, monkeypatch, shape):
    df = spark.createDataFrame([(float(v),) for v in SHAPES[shape]], "x double").repartition(3)
    whole = scale.collect_quantiles(df, {"x": F.col("x")}, PROBS)
    monkeypatch.setattr(scale, "GATHERED", 3)
    monkeypatch.setattr(scale, "CUTS", 6)
    assert scale.collect_quantiles(df, {"x": F.col("x")}, PROBS) == whole


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_are_exact_whatever_the_sample_tells(spark, monkeypatch, shape):
    """The first round counts beside intervals of a sample; a rank outside of them, as a poor sample has it, is found all the same."""
    values = [(float(v), i % 3 + 1) for i, v in enumerate(SHAPES[shape])] + [(float("nan"), 1), (None, 2)]
    df = spark.createDataFrame(values, "x double, fold int").repartition(3)
    columns = {"x": F.col("x"), "y": -F.col("x")}
    whole, folds = scale.collect_quantiles(df, columns, PROBS), scale.quantiles_outside_folds(df, columns, 0.5, "fold", 3)
    monkeypatch.setattr(scale, "GATHERED", 3)
    monkeypatch.setattr(scale, "COLUMNS_AT_ONCE", 1)
    for rows in (1, 10):
        monkeypatch.setattr(scale, "SAMPLED", rows)
        assert scale.collect_quantiles(df, columns, PROBS) == whole
        assert scale.quantiles_outside_folds(df, columns, 0.5, "fold", 3) == folds


@pytest.mark.parametrize("shape", ["normal", "lognormal", "cauchy", "one_infinity", "third_equal"])
def test_ranges_are_balanced_and_bounded(spark, shape):
    """Neither the number of ranges nor what comes to the driver follows the rows, and no range holds far more than its share."""
    r = np.random.default_rng(5)
    x = {"normal": r.normal(size=40_000), "lognormal": r.lognormal(0, 4, 40_000), "cauchy": r.standard_cauchy(40_000),
         "one_infinity": np.append(r.normal(size=40_000), np.inf), "third_equal": np.where(r.random(40_000) < 0.34, 1.0, r.normal(size=40_000))}[shape]
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ranks = scale.sums_below(df, [], "x", {"n": F.lit(1).cast("long")})
        files = spark.read.parquet(*[f for f in ranks.inputFiles() if "/ranks-" in f])
        sizes = [row["count"] for row in files.groupBy("__part").count().collect()]
        got = ranks.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) <= 16 and max(sizes) <= 2 * sum(sizes) / 16
    values, counts = np.unique(x, return_counts=True)
    below = dict(zip(values.tolist(), (np.cumsum(counts) - counts).tolist()))
    assert {row.x: row.below_n for row in got} == below


def test_sums_below_by_group_with_null_groups_and_values(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), (None, 2.0), (None, 5.0), ("b", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {(r.g, "nan" if r.x != r.x else r.x): (r.n, r.below_n) for r in scale.sums_below(df, ["g"], "x", {"n": F.lit(1)}).collect()}
    assert got == {("a", 1.0): (2, 0), ("a", 3.0): (1, 2), ("a", "nan"): (1, 3), (None, 2.0): (1, 0), (None, 5.0): (1, 1)}
    assert scale.sums_below(df.limit(0), ["g"], "x", {"n": F.lit(1)}).collect() == []


def test_quantiles_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, x double")
    got = {r.g: r.quantile for r in scale.exact_quantiles(df, {"x": F.col("x")}, [0.5], by=["g"]).collect()}
    assert got == {"a": 2.0, "b": 10.0}


def test_sums_below(spark):
    x = SHAPES["third_equal"]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    for r in scale.sums_below(df, [], "x", {"n": F.lit(1).cast("long")}).collect():
        assert (r.n, r.below_n) == (int((x == r.x).sum()), int((x < r.x).sum()))


@pytest.mark.parametrize("parts", [1, 13])
def test_rank_by_digest_is_the_plain_row_number(spark, parts):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("x"))).repartition(parts)
    out = scale.rank_by_digest(df, ["g"], ["id"], 7, "rank")
    from pyspark.sql.window import Window
    want = F.row_number().over(Window.partitionBy("g").orderBy(scale.row_digest(["id"], 7)))
    assert out.withColumn("want", want).filter("rank <> want").count() == 0 and out.count() == 500


def test_lookup_with_a_hot_key(spark):
    left = spark.createDataFrame([("hot", k) for k in range(300)] + [("cold", 1)], "k string, v int")
    table = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    out = scale.lookup_by_key(left, table, ["k"], "n", salts=5)
    assert out.count() == 301 and out.filter("k = 'hot' AND top = 299").count() == 300


def p_values(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r double, n double")
    return [r.p for r in df.select("i", correlation_p_value("r", "n").alias("p")).orderBy("i").collect()]


def test_correlation_p(spark):
    rs = (0.0, 0.3, -0.77, 0.999, 1.0)
    assert p_values(spark, [(r, 4.0) for r in rs]) == pytest.approx([1 - abs(r) for r in rs])  # two degrees of freedom
    got = p_values(spark, [(0.5, 3.0), (0.2, 100_000.0), (float("nan"), 10.0), (None, 10.0), (0.5, 2.0)])
    assert got[0] == pytest.approx(2 / 3)  # one: 1 - 2/pi*asin(r)
    assert got[1] == pytest.approx(0.0, abs=1e-12) and got[2:] == [None, None, None]
    # Four degrees of freedom: 1 - r * (3 - r^2) / 2. Many: the normal tail of r * sqrt(n), up to terms of 1 / n.
    assert p_values(spark, [(0.4, 6.0), (-0.9, 6.0)]) == pytest.approx([1 - r * (3 - r * r) / 2 for r in (0.4, 0.9)])
    n = 4_000_000.0
    for z in (0.01, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0):
        assert p_values(spark, [(z / math.sqrt(n), n)])[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)
    # It falls without a jump where the two forms of the fraction meet.
    for n in (12.0, 50.0, 3000.0, 60_000.0):
        line = p_values(spark, [(math.sqrt(1.5 / (n / 2 + 1.5)) * (0.9 + 0.01 * i), n) for i in range(21)])
        steps = np.diff(line)
        assert (steps < 0).all() and steps.min() > 3 * steps.max()


@pytest.mark.parametrize("bins", [100, 4096])
def test_quantiles_outside_folds(spark, monkeypatch, bins):
    """Every fold's quantile over the other folds, from values that are stored once."""
    monkeypatch.setattr(scale, "CUTS", bins)
    monkeypatch.setattr(scale, "GATHERED", 2)
    r = np.random.default_rng(8)
    rows = [(int(f), float(a), None if f == 2 else float(b)) for f, a, b in zip(
        r.integers(1, 4, 500), r.normal(size=500) * 10.0 ** r.integers(-300, 300, 500), r.integers(-2, 3, 500))]
    df = spark.createDataFrame([*rows, (1, None, None)], "fold int, a double, b double").repartition(3)
    got = scale.quantiles_outside_folds(df, {"a": F.col("a"), "b": F.col("b")}, 0.3, "fold", 3)
    for i in (1, 2, 3):
        for k, c in enumerate("ab", 1):
            assert got[i - 1][c] == pytest.approx(np.quantile([x[k] for x in rows if x[0] != i and x[k] is not None], 0.3), rel=1e-12)
    only = df.filter("fold = 2")
    assert scale.quantiles_outside_folds(only, {"a": F.col("a")}, 0.5, "fold", 2)[1] == {"a": None}


def test_values_are_stored_once_for_all_folds_and_searched_in_few_rounds(spark, monkeypatch):
    rounds, kept = [], []
    counted, store = scale._counted, scale.stored
    monkeypatch.setattr(scale, "_counted", lambda t, u, spans, cuts: rounds.append(len(spans)) or counted(t, u, spans, cuts))
    monkeypatch.setattr(scale, "stored", lambda df, name: kept.append(df.columns) or store(df, name))
    monkeypatch.setattr(scale, "GATHERED", 16)
    r = np.random.default_rng(9)
    for x in (r.normal(size=20_000), r.lognormal(0, 30, 20_000), np.where(r.random(20_000) < 0.5, 7.25, r.random(20_000))):
        rounds.clear(), kept.clear()
        df = spark.createDataFrame([(int(i % 5) + 1, float(v)) for i, v in enumerate(x)], "fold int, x double")
        got = scale.quantiles_outside_folds(df, {"x": F.col("x")}, 0.25, "fold", 5)
        assert [g["x"] for g in got] == [pytest.approx(np.quantile(x[np.arange(20_000) % 5 != i], 0.25), rel=1e-12) for i in range(5)]
        assert kept == [["u0", "part"]] and sum(n > 0 for n in rounds) <= 5
