import math

import pytest

from gaugesieve.functions import storage
from gaugesieve.operators import duplicates
from gaugesieve.spec import MeasurementSpec

SCHEMA = "rid string, Test_ID long, Applied_Voltage_kV double, Load_Current_A double"
NAN = float("nan")
ROWS = [
    ("a", 1, 1.0, 2.0), ("a", 1, 1.0, 2.0), ("a", 1, 1.0, 2.0), ("b", 1, 1.0, 2.0), ("c", 2, None, 3.0), ("d", 3, 3.0, None), ("e", None, 0.0, 5.0),
    ("f", None, -0.0, 5.0), ("g", 4, NAN, 1.0), ("h", 5, NAN, 1.0), ("i", 6, None, None), ("j", 7, None, None), ("k", 8, 7.0, 8.0), ("l", 9, 8.0, 7.0),
    (None, 10, 1.5, 1.5), (None, 10, 1.5, 1.5)]


def plain(rows):
    key = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    seen, out = set(), []
    for k in key:
        out.append((k, k in seen, sum(o[1] == k[1] for o in key) > 1, sum(o[2:] == k[2:] for o in key) > 1))
        seen.add(k)
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_duplicate_flags_against_plain_python(spark, monkeypatch, limit):
    """Keys that repeat are broadcast, or looked up by a shuffle where they are many; NULL, NaN and both zeros are one value each."""
    monkeypatch.setattr(duplicates, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(duplicates, "MAX_HOT_KEYS", 1)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = duplicates.duplicate_flags(df, MeasurementSpec(), salts=4, block=2).collect()
    listed = [(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r[:4]), *r[4:]) for r in got]
    assert sorted(listed, key=repr) == plain([tuple(0.0 if v == 0 else v for v in r) for r in ROWS])


def test_rows_that_do_not_repeat_are_not_moved(spark):
    """No window and no shuffle over whole rows but for those whose id and vector both repeat."""
    df = spark.createDataFrame([(str(i), i, float(i), 0.0) for i in range(500)], SCHEMA)
    plan = duplicates.duplicate_flags(df, MeasurementSpec())._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1 and plan.count("Aggregate") == 1


def test_durable_tables_are_columns_on_disk(spark):
    kept = storage.durable(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    assert kept.inputFiles() and kept.count() == 10
    assert "ReadSchema: struct<twice:bigint>" in kept.select("twice")._jdf.queryExecution().executedPlan().toString()
