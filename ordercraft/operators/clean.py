"""Cleaning operators C1-C10 and the composite order-line cleaner (Q1).

Order of steps follows the later cleaner: parse -> fill -> cast id -> date
bound -> dedupe -> whitespace -> line amount -> null fill -> before/after
label. Filling before the date filter keeps continuation lines whose own date
is blank (they take the order's date first).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import ts_ntz
from ..functions.text import collapse_whitespace
from ..session import bounded_side
from ..sources.csv_exports import FIELDS, PLACE, RAW, REASON, SOURCE, Exports, read_typed
from .fill import HOT_MIN_ROWS, SPREAD, find_hot_keys, forward_fill

# Fixed values (parameter defaults taken from the reference's reports).
DEFAULT_START = "2018-01-01"        # keep orders from this date on
DEFAULT_CUTOVER = "2020-03-17"      # before/after label cut-over
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
                     "yyyy-MM-dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")
US_DATE_FORMAT = "M/d/yyyy"


def parse_timestamp(c, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """Text to TIMESTAMP_NTZ trying each format; null when none fits."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats]) \
        .cast(T.TimestampNTZType())


def parse_us_date(c) -> Column:
    """``M/d/yyyy`` text to DATE (accepts ``1/5/2020`` and ``01/05/2020``)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_date(col, US_DATE_FORMAT)


def split_rejects(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Route rows failing ``ok`` to a quarantine frame instead of raising."""
    flag = F.coalesce(ok, F.lit(False))
    return df.filter(flag), df.filter(~flag)


def parse_dates_with_rejects(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """C2 on several columns: parsed rows, and rows with a non-blank bad value."""
    parsed = df.withColumns({f"__p_{c}": parse_us_date(c) for c in cols})
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.col(c).isNull() | F.col(f"__p_{c}").isNotNull())
    good, bad = split_rejects(parsed, ok)
    good = good.withColumns({c: F.col(f"__p_{c}") for c in cols}) \
               .drop(*[f"__p_{c}" for c in cols])
    return good, bad.drop(*[f"__p_{c}" for c in cols])


def fill_nulls_by_type(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Numeric nulls -> 0, boolean -> false, text -> ``'-'``; dates untouched."""
    numeric, boolean, text = [], [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            boolean.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            text.append(f.name)
    fills = {}
    for f in df.schema.fields:
        if f.name in numeric:
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
        elif f.name in boolean:
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(False))
        elif f.name in text:
            fills[f.name] = F.coalesce(F.col(f.name), F.lit("-"))
    return df.withColumns(fills) if fills else df


def dedupe(df: DataFrame, business_cols: Sequence[str] | None = None) -> DataFrame:
    """Full-row dedupe, over the business columns only when given.

    The dedupe is one hash aggregate with map-side combine, so a hot group of
    identical rows collapses before the shuffle.
    """
    return df.dropDuplicates(list(business_cols)) if business_cols else df.dropDuplicates()


def cast_id(df: DataFrame, col: str = "transaction_id") -> tuple[DataFrame, DataFrame]:
    """Cast the id to BIGINT; rows with a null or non-numeric id are rejected."""
    casted = df.withColumn("__id", F.col(col).try_cast("long"))
    good, bad = split_rejects(casted, F.col("__id").isNotNull())
    return good.withColumn(col, F.col("__id")).drop("__id"), bad.drop("__id")


def pre_post(date_col: str = "transaction_date", cutover: str = DEFAULT_CUTOVER) -> Column:
    """``Post`` from the cut-over date on, ``Pre`` before (and for null)."""
    return F.when(F.col(date_col) >= ts_ntz(cutover), F.lit("Post")).otherwise(F.lit("Pre"))


def columns_up_to(df: DataFrame, last: str) -> list[str]:
    """The leading columns through ``last`` (the reference's fill range)."""
    names = df.columns
    return names[: names.index(last) + 1] if last in names else list(names)


def clean_order_lines(df: DataFrame, *, start: str = DEFAULT_START,
                      cutover: str = DEFAULT_CUTOVER,
                      fill_cols: Sequence[str] | None = None,
                      fill_through: str = "category_code",
                      order_tiebreaks: Sequence[str] = ("line_seq",),
                      drop_after_fill: Sequence[str] = ("line_seq",),
                      dedupe_raw: bool = False,
                      hot_keys: Sequence | str | None = None,
                      id_col: str = "transaction_id",
                      date_col: str = "transaction_date",
                      rejects: list | None = None) -> DataFrame:
    """The composite cleaner.

    ``fill_cols`` defaults to every column up to ``fill_through`` (parity:
    product-level blanks are filled too). ``order_tiebreaks`` orders lines of
    one order after the date (nulls last); ``drop_after_fill`` are helper
    columns removed before the dedupe so that they do not keep copies apart.
    ``dedupe_raw`` dedupes the raw lines before filling (avoids false extra
    lines when product-level fields are blank in overlapping pulls).
    ``hot_keys`` (default: probe by sampling) routes very large orders
    through the chunked fill; see :mod:`ordercraft.operators.fill`.
    ``rejects``: when a list is given, (reason, DataFrame) pairs of the
    quarantined rows are appended to it -- text dates no format fits (C1) and
    rows without a usable order id after the fill (C8, D31).
    """
    if date_col in df.columns and isinstance(df.schema[date_col].dataType, T.StringType):
        parsed = df.withColumn("__ts", parse_timestamp(date_col))
        if rejects is not None:
            rejects.append(("unparsed_date", parsed.filter(
                F.col(date_col).isNotNull() & F.col("__ts").isNull()).drop("__ts")))
        df = parsed.withColumn(date_col, F.col("__ts")).drop("__ts")
    if dedupe_raw:
        df = dedupe(df, [c for c in df.columns if c not in drop_after_fill])
    cols = list(fill_cols) if fill_cols is not None else columns_up_to(df, fill_through)
    cols = [c for c in cols if c not in (id_col, *order_tiebreaks)]
    business = [c for c in df.columns if c not in drop_after_fill]
    df = forward_fill(df, id_col, date_col, list(order_tiebreaks), cols, hot_keys=hot_keys,
                      keep_spread=True, spread_cols=business)
    # Rows without a usable order id are rejected (see cast_id for them)
    df, bad_ids = cast_id(df, id_col)
    if rejects is not None:
        rejects.append(("no_order_id", bad_ids.drop(SPREAD)))
    df = df.filter(F.col(date_col) >= ts_ntz(start))
    df = df.drop(*[c for c in drop_after_fill if c in df.columns])
    # the dedupe keys include the id and the fill's spread column, so it runs
    # on the fill's partitioning without another shuffle of the lines
    df = dedupe(df).drop(SPREAD)
    return _derive(df, id_col, date_col, cutover)


def _derive(df: DataFrame, id_col: str, date_col: str, cutover: str) -> DataFrame:
    """The cleaner's last steps: whitespace, line amount, null fill, label."""
    if "product_name" in df.columns:
        df = df.withColumn("product_name", collapse_whitespace("product_name"))
    if "product_price" in df.columns and "product_quantity" in df.columns:
        df = df.withColumn("product_price_x_quantity",
                           F.col("product_price") * F.col("product_quantity"))
    df = fill_nulls_by_type(df, skip=(id_col,))
    return df.withColumn("pre_post", pre_post(date_col, cutover))


# Reasons for which a row cannot be used, besides those of the scan.
NO_ID, BAD_DATE, NO_DATE, BAD_ORDER = "no_order_id", "unreadable_date", "no_date", "order_incomplete"
COPIES = "export_copies"


@dataclass
class Cleaned:
    """Every row of the exports once: merged into ``lines`` (``export_copies``
    equal rows each, at the place ``export_line`` of the first), in ``rejects``
    (file, place, order id, reason, fields, raw line) or in ``early`` (dated
    before the start)."""

    lines: DataFrame
    rejects: DataFrame
    early: DataFrame

    def account(self, by: Sequence[str] = ()) -> DataFrame:
        """Rows of the exports per outcome (and order id, with ``by``)."""
        parts = [self.lines.select(*by, F.lit("reported").alias("outcome"), F.col(COPIES).alias("n")),
                 self.rejects.select(*by, F.col(REASON).alias("outcome"), F.lit(1).cast("long").alias("n")),
                 self.early.select(*by, F.lit("before_start").alias("outcome"), F.lit(1).cast("long").alias("n"))]
        rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return rows.groupBy(*by, "outcome").agg(F.sum("n").alias("n_rows"))


def bad_orders(rows: DataFrame, why: Column, id_col: str) -> DataFrame:
    """Ids of the orders with a row that cannot be used: few, measured before
    the join, so the lines stay where they are while the ids fit a broadcast."""
    ids = rows.where(why.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("bad_id")).distinct()
    return bounded_side(ids, "bad_orders")


def _key_columns(id_col: str, date_col: str) -> list[str]:
    return [f"__id_{id_col}", f"__ts_{date_col}", f"__why_{id_col}_{date_col}"]


def with_keys(rows: DataFrame, id_col: str = "transaction_id", date_col: str = "transaction_date") -> DataFrame:
    """Scanned rows with their typed order id, their parsed date and the reason for
    which they cannot be used: what :func:`clean_exports` needs in each of its
    passes. Given to the scan (``derive``), they are computed and written once."""
    number, date = read_typed(F.col(id_col).cast("string"), T.LongType()), parse_timestamp(date_col)
    bad_date = F.col(date_col).isNotNull() & date.isNull()
    why = F.when(F.col(REASON).isNotNull() | number.isNull() | bad_date, F.coalesce(
        F.col(REASON), F.when(number.isNull(), F.lit(NO_ID)), F.lit(BAD_DATE)))
    return rows.withColumns(dict(zip(_key_columns(id_col, date_col), (number, date, why), strict=True)))


def clean_exports(found: Exports, *, start: str = DEFAULT_START, cutover: str = DEFAULT_CUTOVER,
                  fill_through: str = "category_code", fill_cols: Sequence[str] | None = None,
                  drop: Sequence[str] = (), hot_keys: Sequence | str | None = None,
                  id_col: str = "transaction_id", date_col: str = "transaction_date") -> Cleaned:
    """C10/Q1 over scanned exports: fill in file order, reject whole orders.

    An order is reported whole or not at all: if one of its rows cannot be
    read, or bears an unreadable date, all rows of the order are rejected (the
    others as ``order_incomplete``), and so is an order without any date. Rows
    without a usable id are rejected by themselves. Lines of one order are
    filled in the order (date, blanks last; place in the exports), over the
    columns that the files list up to ``fill_through``. ``drop``: columns left
    out (an export's own line numbers, say). Equal rows of overlapping exports
    are merged; the place of the first is kept.
    """
    rows = found.rows.drop(*drop)
    key, at, why = _key_columns(id_col, date_col)
    if not {key, at, why} <= set(rows.columns):
        rows = with_keys(rows, id_col, date_col)
    names = [c for c in found.rows.columns if c not in (*drop, *found.derived)]
    rows = rows.select(*[F.col(key).alias(c) if c == id_col else F.col(f"`{c}`") for c in names],
                       F.col(at).alias("__ts"), F.col(why).alias("__why"))
    if hot_keys is None:  # looked for in all rows: without the joins and filters below
        hot_keys = find_hot_keys(rows, id_col, HOT_MIN_ROWS)
    bad = bad_orders(rows, F.col("__why"), id_col)
    of_bad = F.col(id_col) == F.col("bad_id")
    whole = rows.where("__why is null")
    out = [SOURCE, PLACE, id_col]

    def rejected(df: DataFrame, reason: Column) -> DataFrame:
        return df.select(*out, reason.alias(REASON), FIELDS, RAW)

    rejects = rejected(rows.where("__why is not null"), F.col("__why")).unionByName(
        rejected(whole.join(bad, of_bad, "left_semi"), F.lit(BAD_ORDER)))

    good = whole.join(bad, of_bad, "left_anti").withColumn(date_col, F.col("__ts")).drop("__why", "__ts")
    listed = [c for c in found.columns if c not in drop]
    cols = list(fill_cols) if fill_cols is not None else listed[:listed.index(fill_through) + 1] \
        if fill_through in listed else listed
    filled = forward_fill(good, id_col, date_col, [PLACE], [c for c in cols if c != id_col], hot_keys=hot_keys,
                          keep_spread=True)
    rejects = rejects.unionByName(rejected(filled.where(F.col(date_col).isNull()), F.lit(NO_DATE)))
    bound = ts_ntz(start)
    early = filled.where(F.col(date_col) < bound).drop(SPREAD, REASON, FIELDS)
    lines = filled.where(F.col(date_col) >= bound)
    # the keys of the merge include the id and the spread, so it runs on the
    # fill's partitioning without another shuffle of the lines
    business = [c for c in lines.columns if c not in (SOURCE, PLACE, RAW, REASON, FIELDS)]
    lines = lines.groupBy(*[F.col(f"`{c}`") for c in business]).agg(
        F.min(PLACE).alias(PLACE), F.count(F.lit(1)).alias(COPIES)).drop(SPREAD)
    places = lines.columns[-2:]
    derived = _derive(lines, id_col, date_col, cutover)
    return Cleaned(derived.select(*[c for c in derived.columns if c not in places], *places), rejects, early)


def columns_matching(df: DataFrame, fragment: str) -> DataFrame:
    """The columns whose name contains ``fragment`` (case-insensitive)."""
    return df.select(df.colRegex(f"`(?i).*{fragment}.*`"))


def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop rows whose ``col`` is one of ``values`` (null rows are kept,
    as a negated membership test in pandas keeps them)."""
    return df.filter(~F.col(col).isin(list(values)) | F.col(col).isNull())
