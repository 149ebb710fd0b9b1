"""Scan a folder of CSV exports, stack them by column NAME, lose nothing.

Headers. Spark's CSV reader maps columns by position, so two exports with
headers ``a,b`` and ``b,a`` would silently mix columns. Files are grouped by
their header line; each group is parsed in that group's column order and the
groups are stacked by name. The stacked order is that of the first file, then
the columns that later files add (as a concatenation gives it).

Records. Files without quoted line breaks are read as lines, so a large file
is many tasks; only files in which a quoted field spans lines are read whole
(``multiLine``). One pass over the lines (an aggregate per file) finds both
the headers and those files.

Values. Every field is read as text and then as its declared type, exactly:
``2.0`` is the whole number 2, ``$3.00`` and ``1,234.50`` are amounts, ``two``,
``2.5`` pieces or a third decimal of an amount are unreadable. Rows with an
unreadable value or with more fields than the header go to the rejects with
their raw line, file and place; blank fields are null, missing last fields
too. Blank lines and copies of the header at the start of a file are no rows.

Places. ``export_line`` is the place of a row in the stacked files (files by
name, rows as they lie in the file): per block of a file the rows are counted,
and a prefix sum over the blocks (one row per block, some 100 MB of input
each) gives the offsets. The parsed lines are written once to the checkpoint
folder, so places stay as they are and no file is parsed twice.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_side, materialize

SOURCE, PLACE, RAW, REASON, FIELDS = "source_file", "export_line", "raw_line", "reject_reason", "reject_fields"
SURPLUS, UNREADABLE = "surplus_fields", "unreadable_value"
EXACT = "decimal(38,10)"


@dataclass
class Exports:
    """Parsed export rows. ``rows`` has the columns of the files (typed where
    declared), ``source_file``, ``export_line``, ``raw_line``, ``reject_reason``
    (null for a row that was read in full) and ``reject_fields``; ``columns``
    are the files' columns in stacked order, ``derived`` those of ``rows`` that
    the scan was given to write with them."""

    rows: DataFrame
    columns: list[str]
    derived: list[str] = field(default_factory=list)

    @property
    def lines(self) -> DataFrame:
        return self.rows.where(F.col(REASON).isNull()).drop(RAW, REASON, FIELDS, *self.derived)

    @property
    def rejects(self) -> DataFrame:
        return reject_table(self.rows.where(F.col(REASON).isNotNull()))


def reject_table(rows: DataFrame) -> DataFrame:
    return rows.select(SOURCE, PLACE, REASON, FIELDS, RAW)


def list_files(spark: SparkSession, pattern: str | Sequence[str]) -> list[str]:
    """The files a path/glob resolves to (Spark's own file listing)."""
    paths = [pattern] if isinstance(pattern, str) else list(pattern)
    return sorted(spark.read.text(paths).inputFiles())


def _split_header(line: str, sep: str) -> tuple[str, ...]:
    return tuple(h.strip() for h in next(csv.reader([line.lstrip("﻿")], delimiter=sep)))


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(value, file, block, at): rows of a block lie in one partition, in file order."""
    return spark.read.text(list(files)).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def header_groups(spark: SparkSession, files: Sequence[str], sep: str = ",") -> dict:
    """Map (header line, whether quoted fields span lines) to the files with it."""
    if not files:
        return {}
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    heads = _lines(spark, files).groupBy("file").agg(
        F.min_by("value", F.when(F.col("block") == 0, F.col("at"))).alias("head"),
        F.max((quotes % 2 == 1).cast("int")).alias("spans"))
    heads = heads.where("head is not null").groupBy("head", "spans").agg(F.collect_list("file").alias("files"))
    return {(r["head"], bool(r["spans"])): sorted(r["files"])
            for r in heads.collect()}  # file names, as the listing that made them


def _names(header: Sequence[str]) -> list[str]:
    """Header names; a repeated one gets a number."""
    seen: dict[str, int] = {}
    out = []
    for h in header:
        k = seen[h.lower()] = seen.get(h.lower(), 0) + 1
        out.append(h if k == 1 else f"{h}_{k}")
    return out


def n_fields(line: Column, sep: str) -> Column:
    """Number of fields of a record: separators outside quotes, plus one."""
    bare = F.when(F.instr(line, '"') > 0, F.regexp_replace(line, '"([^"]|"")*"', "")).otherwise(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _plain(kind: T.DataType) -> str | None:
    """Pattern of the texts that any cast to ``kind`` reads exactly: digits that it holds."""
    digits = {T.IntegerType: 9, T.LongType: 18}.get(type(kind))
    if digits:
        return f"^-?[0-9]{{1,{digits}}}$"
    if isinstance(kind, T.DecimalType) and 0 < kind.scale < kind.precision:
        return rf"^-?[0-9]{{1,{kind.precision - kind.scale}}}(\.[0-9]{{1,{kind.scale}}})?$"
    return None


def read_typed(text: Column, kind: T.DataType) -> Column:
    """A text field as ``kind``, exactly; null if it cannot be read so. Plain
    numbers, the most, are cast at once."""
    plain = _plain(kind)
    if plain is None:
        return _read_exact(text, kind)
    return F.when(text.rlike(plain), text.try_cast(kind)).otherwise(_read_exact(text, kind))


def _read_exact(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    clean = F.regexp_replace(F.trim(text), r"^(-?)\$", "$1")
    if not isinstance(kind, T.NumericType):
        return F.trim(text).try_cast(kind)
    clean = F.when(clean.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(clean, F.lit(","), F.lit(""))).otherwise(clean)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return clean.try_cast(kind)
    exact = clean.try_cast(EXACT)
    return F.when(exact == exact.try_cast(kind), exact.try_cast(kind))


def _parse(spark: SparkSession, head: str, spans: bool, files: Sequence[str], sep: str) -> DataFrame:
    """Records of one header as text fields, with file, block, at and the raw line."""
    names = _names(_split_header(head, sep))
    if spans:
        bad = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__bad"]])
        rows = (spark.read.schema(bad).option("header", True).option("sep", sep).option("multiLine", True)
                .option("escape", '"').option("columnNameOfCorruptRecord", "__bad").csv(list(files)))
        fields = [F.col(f"`{n}`") for n in names]
        rows = rows.select(F.struct(*fields).alias("v"), F.coalesce(
            "__bad", F.to_csv(F.struct(*fields), {"sep": sep, "escape": '"'})).alias("raw"),
            F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"),
            F.monotonically_increasing_id().alias("at"))
    else:
        rows = _lines(spark, files)
        rows = rows.where((F.trim("value") != "") & ~((F.col("block") == 0) & (F.col("value") == F.lit(head))))
        rows = rows.select(F.from_csv("value", _ddl(names), {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}).alias("v"),
                           F.col("value").alias("raw"), "file", "block", "at")
    surplus = n_fields(F.col("raw"), sep) > len(names)
    return rows.select(*[F.nullif(F.col("v")[n], F.lit("")).alias(n) for n in names],
                       "raw", "file", "block", "at", surplus.alias("surplus"))


def _ddl(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def scan_exports(spark: SparkSession, pattern: str | Sequence[str], schema: T.StructType | None = None,
                 sep: str = ",", derive: Callable[[DataFrame], DataFrame] | None = None) -> Exports:
    """Every row of the CSV files under ``pattern``, typed by ``schema`` (None: text).

    ``derive`` adds columns that are written with the parsed rows, so that later
    passes over them do not compute them again (:func:`..operators.clean.with_keys`).
    """
    groups = header_groups(spark, list_files(spark, pattern), sep)
    if not groups:
        raise ValueError(f"no CSV files under {pattern}")
    kinds = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    frames, columns = [], {}
    for (head, spans), files in sorted(groups.items(), key=lambda g: g[1][0]):
        rows = _parse(spark, head, spans, files, sep)
        names = [c for c in rows.columns if c not in ("raw", "file", "block", "at", "surplus")]
        columns |= dict.fromkeys(names)
        typed = {c: read_typed(F.col(f"`{c}`"), kinds[c]) for c in names if c in kinds
                 and not isinstance(kinds[c], T.StringType)}
        # a blank of spaces is no value, of whatever type
        broken = [F.when((F.trim(F.col(f"`{c}`")) != "") & v.isNull(), F.lit(c)) for c, v in typed.items()]
        reason = F.when(F.col("surplus"), F.lit(SURPLUS))
        fields = F.lit("")
        if broken:
            fields = F.concat_ws(",", *broken)
            reason = reason.when(fields != "", F.lit(UNREADABLE))
        frames.append(rows.select(
            *[(typed[c] if c in typed else F.col(f"`{c}`")).alias(c) for c in names],
            F.col("file").alias(SOURCE), "block", "at", F.col("raw").alias(RAW), reason.alias(REASON),
            fields.alias(FIELDS)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for name, kind in kinds.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    names = [*kinds, *[c for c in columns if c not in kinds]]
    helpers = [SOURCE, "block", "at", RAW, REASON, FIELDS]
    out = out.select(*[F.col(f"`{c}`") for c in names], *helpers)
    more = derive(out) if derive else out
    derived = [c for c in more.columns if c not in out.columns]
    rows = materialize(more, "export_lines", compression="zstd")
    return Exports(_places(rows).select(*[F.col(f"`{c}`") for c in names], SOURCE, PLACE, RAW, REASON, FIELDS, *derived),
                   list(columns), derived)


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the stacked files: offsets of the blocks by a prefix sum."""
    blocks = rows.groupBy(F.col(SOURCE).alias("b_file"), F.col("block").alias("b_block")).agg(
        F.min("at").alias("first"), (F.max("at") - F.min("at") + 1).alias("n"))
    # one row per block of input: the one window without a partition
    before = Window.orderBy("b_file", "b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("b_file", "b_block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    joined = rows.join(bounded_side(blocks, "export_blocks"), (F.col(SOURCE) == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    return joined.withColumn(PLACE, F.col("at") + F.col("shift"))


def read_csv_exports(spark: SparkSession, pattern: str | Sequence[str],
                     schema: T.StructType | None = None, sep: str = ",",
                     keep_source: bool = True, rejects: list | None = None) -> DataFrame:
    """The rows of :func:`scan_exports` that were read in full, without helpers.

    With a list, ("unreadable_line", DataFrame) is appended to ``rejects``;
    without one, a row that cannot be read ends the job with its raw line.
    """
    found = scan_exports(spark, pattern, schema, sep)
    if rejects is None:
        message = F.concat(F.lit("unreadable row: "), F.col(RAW))
        ok = F.when(F.col(REASON).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        lines = found.rows.where(ok).drop(RAW, REASON, FIELDS)
    else:
        rejects.append(("unreadable_line", found.rejects))
        lines = found.lines
    return lines.drop(PLACE) if keep_source else lines.drop(PLACE, SOURCE)


def write_csv_export(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> str:
    """Write ``df`` the way the shop exports orders: CSV with a header, the
    given column order, timestamps as ``yyyy-MM-dd HH:mm:ss`` text."""
    out = df.select(*(columns or df.columns))
    (out.write.mode("overwrite").option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path
