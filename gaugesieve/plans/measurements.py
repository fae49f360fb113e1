"""The measurement table of the checks: a projection of ``lineitem`` with planted defects.

The text is valid in Spark SQL and DuckDB alike, so both engines derive the very
same rows; what is checked are the operators that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugesieve.functions.scale import spread_scan
from gaugesieve.spec import MeasurementSpec

SOURCE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
SPEC = MeasurementSpec().with_row_key("rid")

BASE = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
 md5(concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
  CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice*100e0) AS BIGINT) AS STRING))) AS rid,
 8e0 + 24e0*(l_quantity-1e0)/49e0 AS v,
 15e0 + 95e0*CAST(l_partkey % 997 AS DOUBLE)/997e0 AS i,
 18e0 + 37e0*CAST(l_suppkey % 37 AS DOUBLE)/37e0 AS t,
 5e0 + 55e0*CAST(l_orderkey % 89 AS DOUBLE)/89e0 AS d,
 CAST(CAST(round(l_extendedprice*100e0) AS BIGINT) % 101 AS DOUBLE)/101e0 - 5e-1 AS e1,
 CAST(CAST(round(l_extendedprice*100e0) AS BIGINT) % 103 AS DOUBLE)/103e0 - 5e-1 AS e2,
 CAST(CAST(round(l_extendedprice*100e0) AS BIGINT) % 107 AS DOUBLE)/107e0 - 5e-1 AS e3,
 (l_orderkey*7 + l_linenumber*3 + l_partkey) % 13 AS bad,
 (l_partkey + l_linenumber) % 6 AS kind
FROM lineitem"""

MEASUREMENTS = """SELECT rid, l_orderkey*10 + l_linenumber AS Test_ID,
 CASE WHEN bad=0 AND kind=5 THEN 20e0 ELSE v END AS Applied_Voltage_kV,
 CASE WHEN bad=0 AND kind=5 THEN 50e0 ELSE i END AS Load_Current_A,
 CASE WHEN bad=0 AND kind=5 THEN 30e0 ELSE t END AS Ambient_Temperature_C,
 CASE WHEN bad=0 AND kind=5 THEN 10e0 WHEN bad=0 AND kind=0 AND l_suppkey % 7 = 0 THEN 0e0 ELSE d END
  AS Test_Duration_min,
 CASE WHEN bad=0 AND kind=5 THEN 13e0 WHEN bad=0 AND kind=0 THEN 0e0
  WHEN bad=0 AND kind=1 THEN 9e0+3e-1*v+12e-2*i+e1 ELSE 3e-1*v+12e-2*i+e1 END AS Sensor_S1,
 CASE WHEN bad=0 AND kind=5 THEN 13e0 WHEN bad=0 AND kind=2 THEN -1e0
  ELSE 32e-2*v+11e-2*i+e2 END AS Sensor_S2,
 CASE WHEN bad=0 AND kind=5 THEN 16e0 WHEN bad=0 AND kind=3 THEN NULL
  ELSE 4e-1*v+13e-2*i+e3 END AS Sensor_S3,
 CASE WHEN l_orderkey % 34 = 0 THEN NULL
  ELSE 2e1+6e1*CAST((l_orderkey*31+l_partkey) % 251 AS DOUBLE)/251e0 END AS Sensor_S4,
 2e0*v + 5e-1*i AS Reference_Parameter,
 CASE WHEN bad=0 THEN 'Invalid' ELSE 'Valid' END AS Validity_Label
FROM b"""

# Variants: replacement columns and an optional row source.
V, I, T = SPEC.voltage, SPEC.current, SPEC.temperature
VARIANTS = {
    "text": {V: f"CASE WHEN Test_ID % 61 = 0 THEN 'n/a' ELSE CAST(CAST({V} AS DECIMAL(18,6)) AS STRING) END"},
    "inf": {V: f"CASE WHEN Test_ID % 71 = 0 THEN CAST('Infinity' AS DOUBLE) "
               f"WHEN Test_ID % 73 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE {V} END"},
    "neg": {V: f"CASE WHEN Test_ID % 79 = 0 THEN -{V} ELSE {V} END",
            I: f"CASE WHEN Test_ID % 79 = 0 THEN -{I} ELSE {I} END",
            T: f"CASE WHEN Test_ID % 83 = 0 THEN -3e2 ELSE {T} END"},
}
COLUMNS = ["rid", SPEC.id_col, *SPEC.features, SPEC.target_col, SPEC.label_col]
# A pseudo-probability that is known exactly in both engines.
PROBABILITY = ("CASE WHEN Validity_Label='Invalid' THEN 3e-1 ELSE 0e0 END"
               " + 7e-1*CAST((Test_ID*37) % 101 AS DOUBLE)/101e0")


def _variant_columns(name: str) -> list[str]:
    replaced = VARIANTS[name]
    return [f"{replaced[c]} AS {c}" if c in replaced else c for c in COLUMNS]


def measurements(spark: SparkSession, sf_dir: str, variant: str | None = None) -> DataFrame:
    lineitem = spread_scan(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*SOURCE_COLUMNS), "l_orderkey", "l_partkey")
    base = spark.sql(BASE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    table = spark.sql(MEASUREMENTS.replace("FROM b", "FROM {b}"), b=base)
    if variant is None:
        return table
    if variant == "dup":
        return table.unionByName(table.filter(f"{SPEC.id_col} % 51 = 0"))
    return table.selectExpr(*_variant_columns(variant))


def fitting_rows(df: DataFrame) -> DataFrame:
    return df.filter(f"{SPEC.id_col} % 4 != 0")


def scoring_rows(df: DataFrame) -> DataFrame:
    return df.filter(f"{SPEC.id_col} % 4 = 0").drop(SPEC.label_col, SPEC.target_col)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).withColumn("p", F.expr(PROBABILITY))


def sql_with(*ctes: tuple, query: str, variant: str | None = None) -> str:
    """DuckDB text: the measurement CTEs (as table ``m``), further CTEs, the query.

    A CTE is its name and text, and True behind them if it shall be computed once.
    """
    parts = [("b", BASE), ("m0", MEASUREMENTS)]
    if variant is None:
        parts.append(("m", "SELECT * FROM m0"))
    elif variant == "dup":
        parts.append(("m", "SELECT * FROM m0 UNION ALL SELECT * FROM m0 WHERE Test_ID % 51 = 0"))
    else:
        parts.append(("m", f"SELECT {', '.join(_variant_columns(variant))} FROM m0"))
    return with_sql(*parts, *ctes, query=query)


def with_sql(*ctes: tuple, query: str) -> str:
    """DuckDB text of CTEs, as in ``sql_with`` but without the measurements, and a query."""
    listed = [f"{name} AS {'MATERIALIZED ' if once else ''}({text})" for name, text, *once in ctes]
    return "WITH " + ",\n".join(listed) + "\n" + query
