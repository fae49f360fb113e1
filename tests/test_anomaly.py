import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugesieve.operators.iforest import IsolationForestModel, _grow, average_path, fit_isolation_forest
from gaugesieve.operators.lof import fit_lof
from gaugesieve.plans.measurements import SPEC, measurements

SF = "/root/testdata/sf0.001"


def brute_lof(x, k):
    """All-pairs LOF; a scored row counts itself among its neighbours."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    far = d + np.where(np.eye(len(x)) > 0, np.inf, 0)
    fit = np.argsort(far, axis=1, kind="stable")[:, :k]
    rows = np.arange(len(x))[:, None]
    k_distance = far[rows, fit].max(1)
    density = 1 / (np.maximum(far[rows, fit], k_distance[fit]).mean(1) + 1e-10)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = 1 / (np.maximum(d[rows, near], k_distance[near]).mean(1) + 1e-10)
    return density[near].mean(1) / own


@pytest.mark.parametrize("per_cell", [1000, 20])
def test_lof_matches_all_pairs(spark, per_cell):
    x = np.random.default_rng(5).normal(size=(300, 3))
    x[0] *= 20
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double")
    model = fit_lof(df, ["a", "b", "c"], k=7, points_per_cell=per_cell)
    assert model.cells.depth == (0 if per_cell == 1000 else 3)
    got = {r.id: r.lof_score for r in model.score(df).collect()}
    want = brute_lof((x - x.mean(0)) / x.std(0), 7)
    assert [got[i] for i in range(300)] == pytest.approx(list(want), rel=1e-9)
    assert max(got, key=got.get) == 0
    assert model.detect(df).filter("id = 0 AND lof_pred = 1").count() == 1


def test_lof_with_a_third_of_the_rows_equal(spark):
    x = np.random.default_rng(6).normal(size=(120, 2))
    x[:40] = x[0]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double")
    got = {r.id: r.lof_score for r in fit_lof(df, ["a", "b"], k=5, points_per_cell=10).score(df).collect()}
    assert len(got) == 120
    want = brute_lof((x - x.mean(0)) / x.std(0), 5)
    assert [got[i] for i in range(40)] == pytest.approx(list(want[:40]), rel=1e-6)


def test_forest_scores_direction_range_and_repeatability(spark):
    df = measurements(spark, SF)
    columns = list(SPEC.features)
    first = {r.rid: r.anomaly_score for r in fit_isolation_forest(df, columns, trees=50).score(df).collect()}
    again = {r.rid: r.anomaly_score for r in fit_isolation_forest(df.repartition(13), columns, trees=50).score(df).collect()}
    assert first == again and len(first) == df.count()
    assert all(0 < s < 1 for s in first.values())
    wild = df.limit(1).withColumns({c: F.lit(1e6) for c in columns})
    model = fit_isolation_forest(df, columns, trees=50)
    assert model.score(wild).first().anomaly_score > np.median(list(first.values()))


def test_average_path():
    assert average_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(average_path(256)) == pytest.approx(2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_complete_trees_end_where_the_grown_ones_do():
    """A leaf above the last level is carried on to it, so that scoring takes the same steps for every row."""
    x = np.random.default_rng(5).normal(size=(300, 3)).round(1)
    feature, cut, path = np.full((1, 63), -1, np.int64), np.zeros((1, 63)), np.zeros((1, 63))
    for node, f, c, p in _grow(x[:40], 42, 0, 5):
        feature[0, node], cut[0, node], path[0, node] = f, c, p
    features, cuts, paths = IsolationForestModel(["a", "b", "c"], {}, feature, cut, path, 40)._complete(5)
    for row in x:
        node = end = 0
        while feature[0, node] >= 0:
            node = 2 * node + 1 + int(row[feature[0, node]] > cut[0, node])
        for _ in range(5):
            end = 2 * end + 1 + int(row[features[0, end]] > cuts[0, end])
        assert paths[0, end] == path[0, node]
