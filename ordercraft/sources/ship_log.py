"""A ship log with one schema and an append that can be repeated.

The log is a Parquet folder keyed by ``order_no`` or ``transaction_id``. New
rows are brought to the log's own columns (its name of the key, its types);
columns that the log lacks are added, and :func:`read_log` reads old and new
files with the columns of all. An append goes in three steps: the new rows
are written beside the log under a key taken from their content, with a row
number; one row in a list of batches says that the batch is complete; the
rows that are not yet in the log are appended, and the batch is marked done.
A run that broke off is finished by the next one, row by row, and a repeated
run finds its orders in the log and appends nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SHIP_LOG_HEADERS

KEYS = ("order_no", "transaction_id")
BATCH, ROW = "batch_key", "batch_row"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with the columns of all its files. A log that holds both names of
    the key (appended under the wrong one) is read with one."""
    log = spark.read.option("mergeSchema", True).parquet(path)
    both = [k for k in KEYS if k in log.columns]
    if len(both) > 1:
        log = log.withColumn(both[0], F.coalesce(*both)).drop(*both[1:])
    return log


def key_of(log: DataFrame) -> str:
    for c in log.columns:
        if c in KEYS or SHIP_LOG_HEADERS.get(c) == "order_no":
            return c
    raise ValueError(f"the log has no key column ({', '.join(KEYS)})")


def as_log_rows(new: DataFrame, log: DataFrame) -> DataFrame:
    """``new`` with the log's name of the key and the log's types."""
    key = key_of(log)
    rows = new.withColumnsRenamed({k: key for k in KEYS if k in new.columns and k != key})
    kinds = {f.name: f.dataType for f in log.schema.fields}
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])


def _batches(spark: SparkSession, path: str, which: str) -> DataFrame:
    try:
        return spark.read.schema(f"{BATCH} string").parquet(f"{path.rstrip('/')}_batches/{which}")
    except AnalysisException:  # none yet
        return spark.createDataFrame([], f"{BATCH} string")


def _mark(spark: SparkSession, path: str, which: str, key: str) -> None:
    spark.createDataFrame([(key,)], f"{BATCH} string").coalesce(1) \
         .write.mode("append").parquet(f"{path.rstrip('/')}_batches/{which}")


def finish_batches(spark: SparkSession, path: str) -> list[str]:
    """Append what complete but unfinished batches still lack in the log; their keys."""
    done = _batches(spark, path, "done").distinct()
    pending = [r[0] for r in _batches(spark, path, "complete").distinct().join(done, BATCH, "left_anti").collect()]
    for key in pending:  # broken-off runs: one at most, unless several broke off
        rows = spark.read.parquet(f"{path.rstrip('/')}_batches/rows/{key}")
        log = read_log(spark, path)
        if ROW in log.columns:
            there = log.where(F.col(BATCH) == key).select(BATCH, ROW)
            rows = rows.join(there, [BATCH, ROW], "left_anti")
        rows.write.mode("append").parquet(path)
        _mark(spark, path, "done", key)
    return pending


def append(new: DataFrame, path: str) -> str | None:
    """Append ``new`` (rows of orders that are not in the log) as one batch; its
    key, None without rows."""
    spark = new.sparkSession
    rows = as_log_rows(new, read_log(spark, path).drop(BATCH, ROW))
    n, content = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns))).first()
    if not n:
        return None
    key = f"{n}-{content & (1 << 64) - 1:016x}"
    rows.withColumns({BATCH: F.lit(key), ROW: F.monotonically_increasing_id()}) \
        .write.mode("overwrite").parquet(f"{path.rstrip('/')}_batches/rows/{key}")
    _mark(spark, path, "complete", key)
    finish_batches(spark, path)
    return key
