import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugesieve.functions import ranks
from gaugesieve.operators import classstats
from gaugesieve.spec import MeasurementSpec

SPEC = MeasurementSpec()


def columns(n: int = 1200) -> pd.DataFrame:
    r = np.random.default_rng(4)
    x = r.normal(size=n)
    frame = pd.DataFrame({
        "near": x, "other": 0.5 * x + r.normal(size=n), "hot": np.where(r.random(n) < 0.4, 3.25, r.normal(size=n)), "few": r.integers(-2, 3, n).astype(float),
        "zeros": np.where(r.random(n) < 0.5, -0.0, 0.0) + (r.random(n) < 0.2), "constant": np.full(n, 13.3), "nothing": np.full(n, np.nan)})
    for c in ("other", "few"):
        frame.loc[r.random(n) < 0.2, c] = np.nan
    return frame


def spark_frame(spark, frame: pd.DataFrame):
    listed = [tuple(None if v != v else v for v in row) for row in frame.itertuples(index=False)]
    kinds = ", ".join(f"{c} {'string' if frame[c].dtype == object else 'double'}" for c in frame.columns)
    return spark.createDataFrame(listed, kinds).repartition(3)


def plain(a: pd.Series, b: pd.Series):
    both = a.notna() & b.notna()
    a, b = a[both], b[both]
    if len(a) < 1 or a.nunique() < 2 or b.nunique() < 2:
        return len(a), None, None
    return len(a), np.corrcoef(a, b)[0, 1], np.corrcoef((a + 0.0).rank(), (b + 0.0).rank())[0, 1]


def close(got, want) -> bool:
    return got is None if want is None else got == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("block, wanted", [(65_535, 500_000), (100, 90)])
def test_pair_correlations_match_plain_ranks(spark, monkeypatch, block, wanted):
    """Whatever the blocks and ranges: with ties, a hot value, nulls of a partner, both zeros, a constant and an empty column."""
    monkeypatch.setattr(ranks, "BLOCK", block)
    monkeypatch.setattr(ranks, "RANGE_VALUES", wanted)
    frame = columns()
    names = list(frame.columns)
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    got = {r["pair"]: r for r in ranks.pair_correlations(spark_frame(spark, frame), [F.col(c) for c in names], pairs).collect()}
    for p, (a, b) in enumerate(pairs):
        n, r, rho = plain(frame[names[a]], frame[names[b]])
        if n == 0:
            assert p not in got
        else:
            assert got[p]["n"] == n and close(got[p]["r"], r) and close(got[p]["rho"], rho), (names[a], names[b], got[p], r, rho)


@pytest.mark.parametrize("block, wanted", [(65_535, 500_000), (100, 90)])
def test_label_associations_match_plain_ranks(spark, monkeypatch, block, wanted):
    monkeypatch.setattr(ranks, "BLOCK", block)
    monkeypatch.setattr(ranks, "RANGE_VALUES", wanted)
    frame = columns()
    frame["Validity_Label"] = np.random.default_rng(6).choice(np.array(["Valid", "Invalid", "Unknown", None], object), len(frame))
    names = [c for c in columns(1).columns if c != "nothing"]
    y = (frame["Validity_Label"] == "Invalid").astype(float)
    listed = [tuple(None if v is None or v != v else v for v in row) for row in frame.itertuples(index=False)]
    df = spark.createDataFrame(listed, ", ".join(f"`{c}` {'string' if c == 'Validity_Label' else 'double'}" for c in frame.columns)).repartition(3)
    got = {r.Feature: r for r in classstats.label_associations(df, SPEC, [*names, "nothing"]).collect()}
    assert set(got) == set(names)
    for c in names:
        _, r, rho = plain(frame[c], y)
        assert close(got[c].PointBiserial_Corr, r) and close(got[c].Spearman_Corr, rho), (c, got[c], r, rho)


def test_class_moments_are_taken_once_per_class(spark):
    """Counts, means and deviations of the classes, a class of one row and an absent one among them."""
    rows = [("Valid", 1.0), ("Valid", 4.0), ("Valid", None), ("Invalid", 7.0), ("Other", 100.0), (None, None)]
    df = spark.createDataFrame(rows, "Validity_Label string, x double")
    got = classstats._per_class(df, SPEC, ["x"]).first()
    assert (got.rows, got.v_rows, got.i_rows, got.v_n_0, got.i_n_0) == (6, 3, 1, 2, 1)
    assert (got.v_mean_0, got.i_mean_0, got.i_std_0, got.i_var_0) == (2.5, 7.0, None, None)
    assert got.v_std_0 == pytest.approx(4.5 ** 0.5) and got.v_var_0 == pytest.approx(4.5)
    assert got.r_0 == pytest.approx(np.corrcoef([1.0, 4.0, 7.0, 100.0], [0, 0, 1, 0])[0, 1])
    one = classstats._per_class(df.filter("Validity_Label = 'Valid'"), SPEC, ["x"]).first()
    assert (one.i_rows, one.i_n_0, one.i_mean_0, one.r_0) == (0, 0, None, None)
    empty = classstats._per_class(df.limit(0), SPEC, ["x"]).first()
    assert (empty.rows, empty.v_rows, empty.v_n_0, empty.v_mean_0, empty.r_0) == (0, 0, 0, None, None)


def test_a_column_is_derived_once_for_moments_and_ranks(spark, monkeypatch):
    """The columns are stored, and of them only a block's distinct values travel, however often they repeat."""
    kept = []
    store = classstats.stored
    monkeypatch.setattr(classstats, "stored", lambda df, name: kept.append(df.columns) or store(df, name))
    df = spark.range(4000).selectExpr("CAST(id % 5 AS double) AS x", "IF(id % 3 = 0, 'Invalid', 'Valid') AS Validity_Label")
    got = classstats.label_associations(df, SPEC, ["x"]).first()
    assert kept == [["x", "Validity_Label"]] and abs(got.Spearman_Corr) < 0.01
    dealt = df.select(F.col("x").alias("v0"), (F.col("Validity_Label") == "Invalid").alias("y")).coalesce(1).mapInArrow(
        ranks._labelled([np.array([2.0])]), "k int, range int, data binary, tally binary")
    assert sorted((r["range"], len(r["data"])) for r in dealt.collect()) == [(0, 16), (1, 24)]
