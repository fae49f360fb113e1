"""The queries fit on every labelled row, and with the library's own settings where they name no others."""

import pytest
from pyspark.sql import functions as F

from gaugesieve.operators import models
from gaugesieve.plans import checks_models
from gaugesieve.plans.measurements import SPEC


class Asked(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """What an operator of ``models`` is called with; the call itself ends there."""
    def watch(name):
        def call(*args, **options):
            raise Asked(args, options)
        monkeypatch.setattr(models, name, call)
    monkeypatch.setattr(checks_models, "measurements", lambda spark, sf_dir: None)

    def run(query, name):
        watch(name)
        with pytest.raises(Asked) as told:
            query(None, "nowhere")
        return told.value.args
    return run


@pytest.mark.parametrize("config", [checks_models.FOREST, checks_models.FINAL_FOREST, checks_models.BOOSTING, checks_models.LOGISTIC])
def test_a_fit_sees_every_row(spark, config):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("rid"))
    assert models.fitting_sample(rows, SPEC, config, 42).count() == 5000


@pytest.mark.parametrize("query", [checks_models.grid_screening, checks_models.grid_baseline, checks_models.grid_final])
def test_grids_run_the_library_s_own_configurations(asked, query):
    _, options = asked(query, "evaluate_grid")
    assert all(c == models.CLASSIFIERS[n] for n, c in (options.get("configs") or {}).items())


def test_compared_models_see_every_row(asked):
    args, _ = asked(checks_models.model_comparison, "cross_validate")
    assert [c.max_rows for c in args[2]] == [None, None, None]


def test_out_of_fold_rows_come_from_the_whole_forest(asked):
    args, _ = asked(checks_models.out_of_fold_rows, "out_of_fold")
    assert args[2] == models.CLASSIFIERS["Random_Forest"]
