"""Side tables (price table, ship log) read with declared schemas.

Workbooks are re-aimed as tables: each former sheet is a Parquet folder or a
CSV file with a header. The price table and the ship log are small next to
the order lines; the joins that use them leave the broadcast decision to the
planner's size check and AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PRICING, SHIP_LOG

# The ship log's column headers as typed in the office sheet.
SHIP_LOG_HEADERS = {"Order #": "order_no", "transaction_id": "order_no",
                    "Actual Freight Expense": "actual_freight_expense"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    reader = spark.read
    if fmt == "csv":  # all text, then cast by name: a given schema would map by position
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.format(fmt).load(path)
    if schema is not None:
        df = df.select(*[F.col(f.name).try_cast(f.dataType) for f in schema.fields
                         if f.name in df.columns])
    return df


def read_pricing(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """S3: the price table (key: name, options, price, weight)."""
    return read_table(spark, path, PRICING, fmt)


def read_ship_log(spark: SparkSession, path: str, fmt: str | None = None,
                  all_columns: bool = False) -> DataFrame:
    """The ship log. By default only (order_no, freight); with
    ``all_columns`` every column of the sheet (later variant)."""
    df = read_table(spark, path, None, fmt).withColumnsRenamed(SHIP_LOG_HEADERS)
    if all_columns:
        return df
    return df.select(*[F.col(f.name).cast(f.dataType) for f in SHIP_LOG.fields])
