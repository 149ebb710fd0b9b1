"""Incremental ship-log update (J9 + S13) on Structured Streaming.

New order-line files land in a folder; each micro-batch keeps the lines of
orders that were not typed into the log by hand and that the log does not
hold yet, line by line, and appends them. Re-running a batch after a failure
adds only the lines that the failed attempt has not written, and lines of an
order that arrive in a later batch than its first ones are added then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.shipping import LOG_UPDATE_COLUMNS
from ..sources.ship_log import key_of, read_log

ID, PRODUCT = "transaction_id", "product_name"


def _log(spark: SparkSession, log_path: str) -> DataFrame:
    try:
        log = read_log(spark, log_path)
        return log.withColumnRenamed(key_of(log), ID)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything but the first batch's missing log
            raise
        return spark.createDataFrame([], T.StructType([T.StructField(ID, T.LongType())]))


def new_log_rows(batch: DataFrame, log: DataFrame,
                 columns: Sequence[str] = LOG_UPDATE_COLUMNS) -> DataFrame:
    """Lines missing from the log, in log columns, without repeats: an order typed
    in by hand (a log row without a product) is complete, the others grow by line."""
    rows = batch.filter(F.col(ID).isNotNull()).select(*columns).dropDuplicates()
    fed = F.col(PRODUCT).isNotNull() if PRODUCT in log.columns else F.lit(False)
    rows = rows.join(log.filter(F.col(ID).isNotNull() & ~fed).select(ID).distinct(), ID, "left_anti").select(*columns)
    return rows.subtract(log.filter(fed).select(*columns)) if PRODUCT in log.columns else rows


def start_ship_log_feed(spark: SparkSession, lines_dir: str, schema: T.StructType,
                        log_path: str, checkpoint_dir: str,
                        available_now: bool = True,
                        columns: Sequence[str] = LOG_UPDATE_COLUMNS) -> StreamingQuery:
    """Watch ``lines_dir`` (Parquet order lines) and append new orders to the log.

    ``available_now`` processes what is there and stops (scheduled runs);
    otherwise the query keeps running with a one-minute trigger.
    """
    # drops may land in sub-folders (one per export run)
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", True)
              .parquet(lines_dir))

    def append_batch(batch: DataFrame, _epoch: int) -> None:
        new = new_log_rows(batch, _log(batch.sparkSession, log_path), columns)
        new.write.mode("append").parquet(log_path)

    writer = (stream.writeStream.foreachBatch(append_batch)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()
