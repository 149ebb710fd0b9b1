"""Sinks S6-S13: exception files, partitioned results, versioned refreshes,
named multi-table exports, split exports and ship-log appends.

Workbook output is re-aimed as table writes (Parquet by default, CSV with a
header where people open the file). Nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_side, row_bytes


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_exceptions(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Rows needing attention (no price, no freight) for follow-up."""
    return write_table(df, path, fmt)


FILE_BYTES = 256 * 1024 * 1024


def write_folders(df: DataFrame, path: str, folders: Sequence[str], file_bytes: int = FILE_BYTES,
                  fmt: str = "parquet") -> str:
    """One folder per value of ``folders``, in files planned by size.

    The bytes of each folder are summed first (one row per folder); a folder gets
    as many files as it needs at about ``file_bytes`` (before compression), each
    written by one task: a small folder is one file, a skewed one is several."""
    folders = list(folders)
    sizes = df.groupBy(*folders).agg(F.sum(row_bytes(df).cast("long")).alias("__bytes"))
    sizes = sizes.withColumn("__files", F.greatest(F.ceil(F.col("__bytes") / file_bytes), F.lit(1)).cast("long"))
    before = Window.orderBy(*folders).rowsBetween(Window.unboundedPreceding, -1)  # one row per folder
    plan = bounded_side(sizes.select(*[F.col(c).alias(f"__f_{c}") for c in folders], "__files",
                                     F.coalesce(F.sum("__files").over(before), F.lit(0)).alias("__first")), "file_plan")
    total = plan.agg(F.sum("__files")).first()[0] or 1
    on = F.lit(True)
    for c in folders:
        on = on & F.col(c).eqNullSafe(F.col(f"__f_{c}"))
    file_no = (F.col("__first") + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("__files"))).cast("int")
    rows = df.join(plan, on).withColumn("__file", file_no)
    rows = rows.repartitionById(int(total), "__file").select(*[F.col(f"`{c}`") for c in df.columns])
    return write_table(rows, path, fmt, partition_by=folders)


def write_order_lines(df: DataFrame, path: str, date_col: str = "transaction_date",
                      file_bytes: int = FILE_BYTES) -> str:
    """Joined lines partitioned by order month, so later readers prune."""
    return write_folders(df.withColumn("order_month", F.date_format(date_col, "yyyy-MM")), path,
                         ["order_month"], file_bytes)


def _stamp() -> str:
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    return f"{now}-{uuid.uuid4().hex[:6]}"


def _safe(name: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in name)


def write_versioned(df: DataFrame, base: str, name: str, version: str | None = None,
                    fmt: str = "parquet") -> str:
    """A refreshed table goes to a new version folder, never over its input,
    and is published there (see :func:`read_published`)."""
    return write_named_tables({name: df}, base, fmt, version)[name]


def write_csv(df: DataFrame, path: str) -> str:
    """A CSV with a header line (e.g. the 'to add' list)."""
    return write_table(df, path, "csv")


def write_named_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet",
                       version: str | None = None) -> dict:
    """Several named tables as one set: each is written to its own folder of a
    new version, and one manifest row, written last, publishes them together. A
    failure before it leaves the set published before as it was. Returns the paths."""
    base, version = base.rstrip("/"), version or _stamp()
    out = {name: write_table(df, f"{base}/{_safe(name)}/version={version}", fmt) for name, df in tables.items()}
    if out:
        spark = next(iter(tables.values())).sparkSession
        rows = [(version, _stamp(), name, path, fmt) for name, path in out.items()]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return out


MANIFEST = "version string, published string, name string, path string, format string"


def read_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` of the set published last (:func:`write_named_tables`)."""
    base = base.rstrip("/")
    found = spark.read.schema(MANIFEST).parquet(f"{base}/manifest").where(F.col("name") == name)
    last = found.agg(F.max_by(F.struct("version", "format"), "published")).first()[0]
    if last is None:
        raise ValueError(f"no published table {name!r} under {base}")
    reader = spark.read.format(last["format"])
    if last["format"] == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{base}/{_safe(name)}/version={last['version']}")


def write_split(df: DataFrame, base: str, level0: str, level1: str,
                keep: Sequence | None = None, as_of: str | None = None,
                fmt: str = "parquet") -> str:
    """One folder per first-level key, one part per second-level key,
    under an as-of folder."""
    as_of = as_of or dt.date.today().isoformat()
    if keep is not None:
        df = df.filter(F.col(level0).isin(list(keep)))
    return write_folders(df, f"{base.rstrip('/')}/as_of={as_of}", [level0, level1], fmt=fmt)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Append new rows to a log table."""
    return write_table(df, path, fmt, mode="append")
