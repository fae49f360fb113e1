"""Collection of checks: a Spark query by name and, where SQL can state it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six places, without negative zero."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema])


def rounded_sql(query: str, doubles) -> str:
    if not doubles:
        return query
    replaced = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) + 0e0 AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({replaced}) FROM (\n{query}\n) AS result"


@dataclass
class Checks:
    """A family of checks, filled by the decorator ``check``."""

    builders: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def check(self, name: str, sql: str | None = None, doubles=()):
        def register(build):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return rounded(build(spark, sf_dir))

            self.builders[name] = query
            if sql is not None:
                self.sql[name] = rounded_sql(sql, doubles)
            return build
        return register


def tagged(results: dict[str, DataFrame]) -> DataFrame:
    """All rows of several reports in one table, columns by name."""
    parts = [df.select(F.lit(name).alias("report"), "*") for name, df in results.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def tagged_sql(texts: dict[str, str]) -> str:
    return "\nUNION ALL BY NAME\n".join(f"SELECT '{name}' AS report, * FROM ({text})" for name, text in texts.items())
