"""Registry of named analyses: a Spark callable and (where SQL can say it) an
independent DuckDB oracle query for each.

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame
built from the base tables of that folder. Output columns are cast the same
way in both engines: money sums to DOUBLE, counts to BIGINT, buckets to DATE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixtures import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Parameters used against the test tables (dates there run from
# 1995-01-01 to 2001-08-01, so the reference's 2018/2020 bounds are moved).
CUTOVER = "1998-01-01"
START = "1996-01-01"
SINCE = "2000-01-01"
FREIGHT_SINCE = "2000-01-01"


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast DECIMAL columns to DOUBLE (exact sums first, double on output)."""
    casts = {f.name: F.col(f.name).cast("double") for f in df.schema.fields
             if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(casts) if casts else df


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
