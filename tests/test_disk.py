"""What operators leave on disk, and ranks whose rows move once."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions import scale, storage


def names(spark):
    return set(os.listdir(storage.shared_folder(spark).removeprefix("file:")))


def test_a_quantile_search_leaves_nothing(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"))
    before = names(spark)
    assert scale.collect_quantiles(df, {"x": F.col("x")}, [0.5])["x"] == {0.5: 1499.5}
    assert names(spark) == before


def test_a_table_can_outlast_its_scope(spark):
    with storage.scratch(spark):
        with storage.scratch(spark):
            inner, outer = storage.stored(spark.range(3)), storage.outlasting(spark.range(4))
        assert outer.count() == 4
        with pytest.raises(Exception):
            inner.count()
    with pytest.raises(Exception):
        outer.count()


@pytest.mark.parametrize("crowded", [1, 100_000])
def test_ranks_with_a_key_that_a_third_of_the_rows_have(spark, monkeypatch, crowded):
    """Equal keys share the first number of theirs, whether or not their bucket is taken for crowded; groups may be null."""
    monkeypatch.setattr(scale, "CROWDED", crowded)
    key = F.when(F.col("id") % 3 == 0, "same").when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string"))
    df = spark.range(9000).select("id", key.alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("g")).repartition(5)
    for by in ([], ["g"]):
        got = scale.rank_by_digest(df, by, ["k"], 7, "rank")
        want = F.rank().over(W.partitionBy(*(by or [F.lit(1)])).orderBy(scale.row_digest(["k"], 7)))
        assert got.columns == ["id", "k", "g", "rank"] and got.schema["rank"].dataType.simpleString() == "bigint"
        assert got.withColumn("want", F.col("rank")).exceptAll(df.withColumn("rank", want.cast("long")).withColumn("want", F.col("rank"))).count() == 0
        assert got.count() == 9000


def test_rows_move_once_to_be_ranked(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    plan = scale.rank_by_digest(df, [], ["k"], 7, "rank")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


def test_baseline_predictions_store_no_wide_frame(spark, monkeypatch):
    from gaugesieve.operators import baselines
    from gaugesieve.plans.checks_models import EXACT
    from gaugesieve.plans.measurements import SPEC
    wide = []
    write = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name="stored": wide.append(len(df.columns)) or write(df, name))
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("rid"), F.col("id").alias("Test_ID"), F.lit("Valid").alias("Validity_Label"), F.lit(1.0).alias("Reference_Parameter"),
        *[((F.col("id") * (7 + i)) % 31 + 1.0).alias(c) for i, c in enumerate(SPEC.features)])
    frame = baselines.baseline_predictions(rows, SPEC, forest_trees=5, methods=EXACT)
    assert frame.select("rid", "iforest_score").count() == 400 and max(wide, default=0) <= len(SPEC.features)


def test_an_audit_stores_its_rows_once(spark, monkeypatch):
    from gaugesieve.operators import audit
    from gaugesieve.plans.measurements import SPEC
    kept, write = [], audit.stored
    monkeypatch.setattr(audit, "stored", lambda df, name="stored": kept.append(name) or write(df, name))
    rows = spark.range(60).select(F.col("id").cast("string").alias("rid"), (F.col("id") % 59).alias("Test_ID"),
                                  *[((F.col("id") * (7 + i)) % 31 + 1.0).alias(c) for i, c in enumerate(SPEC.features)])
    reports = audit.run_audit(rows, rows.limit(40), SPEC)
    assert kept == ["flagged", "flagged"] and reports["flags_train"].count() == 60 and reports["flags_test"].count() == 40
    assert {r.RepeatCount for r in reports["repeated_ids_train"].collect()} == {2}


def test_associations_leave_only_their_own_few_rows(spark):
    from gaugesieve.operators.classstats import label_associations
    from gaugesieve.plans.measurements import SPEC
    rows = spark.range(300).select(F.col("id").cast("string").alias("rid"), F.when(F.col("id") % 5 == 0, "Invalid").otherwise("Valid").alias("Validity_Label"),
                                   *[((F.col("id") * (7 + i)) % 31 + 1.0).alias(c) for i, c in enumerate(SPEC.features)])
    before = names(spark)
    found = label_associations(rows, SPEC, columns=list(SPEC.features))
    assert {n.rsplit("-", 1)[0] for n in names(spark) - before} == {"associations"}
    assert found.count() == len(SPEC.features) and found.filter("Spearman_Corr IS NULL").count() == 0
