"""Forward fill within a group, in an explicit row order.

``forward_fill`` gives every blank the latest earlier non-blank value of the
same group (order: first column ascending with nulls last, then the
tie-break columns). Rows with a null group key are left untouched.

Plan shape
----------
* Ordinary keys: one window (one shared spec -> one sort) partitioned by the
  key, with ``last(c, ignorenulls)`` over ``ROWS UNBOUNDED PRECEDING``.
* Hot keys (a single order may hold a large share of all rows): a window on
  one key would put the whole group into one task. Those keys are processed
  as a segmented scan over bounded chunks instead:

  1. rows are numbered within their key (``number_rows``: range partitions,
     so no task holds a whole group) and cut into chunks of ``chunk_rows``
     consecutive rows, whatever their dates and tie-breaks are; the numbered
     rows are written once, so equal sort keys keep their places;
  2. fill inside each chunk with a window on (key, chunk);
  3. aggregate one row per chunk holding each column's last non-null value
     (partial aggregation, no skew);
  4. carry those values forward across the chunks of a key with a window over
     the small per-chunk table (rows / chunk_rows entries per key);
  5. join the carry back on (key, chunk) and use it where the chunk-local
     fill is still blank.

  Hot keys are found with a sampled count (``find_hot_keys``) and applied as
  an ``IN`` filter, so no join is needed to split the input. A missed hot key
  is still filled correctly by the window path, only slower.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


TIE = "__tie"
HOT_MIN_ROWS = 5_000_000  # rows from which a key is too large for one task


def _with_tie(df: DataFrame, tiebreaks: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Without tie-break columns rows of equal place are ordered by a hash of the
    row, so that both paths of the fill see one order."""
    if tiebreaks:
        return df, list(tiebreaks)
    return df.withColumn(TIE, F.xxhash64(*df.columns)), [TIE]


def _order_exprs(first: str, tiebreaks: Sequence[str]) -> list[Column]:
    return [F.col(first).asc_nulls_last(), *[F.col(t).asc() for t in tiebreaks]]


def find_hot_keys(df: DataFrame, key: str, min_rows: int, fraction: float = 0.01,
                  seed: int = 17) -> list:
    """All keys estimated (by a sampled count) to hold at least ``min_rows`` rows.

    There are at most about rows / ``min_rows`` of them. Sampling keeps the
    probe to one cheap pass.
    """
    est = F.count(F.lit(1)) / F.lit(fraction)
    rows = (df.select(key).filter(F.col(key).isNotNull())
              .sample(fraction=fraction, seed=seed)
              .groupBy(key).agg(est.alias("est"))
              .filter(F.col("est") >= min_rows)
              .collect())
    return [r[0] for r in rows]


SPREAD = "__spread"


def _window_fill(df: DataFrame, key: str, order_first: str, tiebreaks: Sequence[str],
                 fill_cols: Sequence[str], spread_cols: Sequence[str] | None = None) -> DataFrame:
    # Null keys are never filled; spread them over partitions by a row hash
    # so they do not form one giant window partition. The spread is a column
    # (null for keyed rows, a hash of the whole row otherwise) so that a later
    # full-row dedupe that includes it can reuse this partitioning: equal rows
    # have equal keys and equal hashes.
    df = df.withColumn(SPREAD, F.when(F.col(key).isNull(),
                                      F.xxhash64(*(spread_cols or df.columns))))
    w = (Window.partitionBy(key, SPREAD)
         .orderBy(*_order_exprs(order_first, tiebreaks))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = {c: F.when(F.col(key).isNull(), F.col(c))
                  .otherwise(F.last(c, ignorenulls=True).over(w))
              for c in fill_cols}
    return df.withColumns(filled)


POS, CHUNK = "__pos", "__chunk"


def number_chunks(df: DataFrame, key: str, order_first: str, tiebreaks: Sequence[str],
                  chunk_rows: int) -> DataFrame:
    """``df`` (no null keys) with each row's place within its key and its chunk:
    ``chunk_rows`` consecutive places. Without a tie-break column, rows of equal
    ``order_first`` are ordered by a hash of the row."""
    df, ties = _with_tie(df, tiebreaks)
    numbered = number_rows(df, key, [order_first, *ties], POS, hot_keys="all",
                           nulls_last=(order_first,), null_keys=False).drop(TIE)
    chunk = F.floor((F.col(POS) - 1) / F.lit(chunk_rows))
    return materialize(numbered.withColumn(CHUNK, chunk), "fill_chunks")


def _chunked_fill(df: DataFrame, key: str, order_first: str, tiebreaks: Sequence[str],
                  fill_cols: Sequence[str], chunk_rows: int) -> DataFrame:
    rows = number_chunks(df, key, order_first, tiebreaks, chunk_rows)

    # 2. fill inside each chunk
    w_local = (Window.partitionBy(key, CHUNK).orderBy(POS)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(w_local) for c in fill_cols})

    # 3. last non-null value per chunk
    summary = rows.groupBy(key, CHUNK).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"__last_{c}")
          for c in fill_cols])

    # 4. carry across the chunks of one key (small: one row per chunk)
    w_carry = (Window.partitionBy(key).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(
        key, CHUNK,
        *[F.last(f"__last_{c}", ignorenulls=True).over(w_carry).alias(f"__carry_{c}")
          for c in fill_cols])

    # 5. join back
    joined = filled.join(carry, [key, CHUNK], "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__carry_{c}")).alias(c)
                           if c in fill_cols else F.col(c) for c in df.columns])


def forward_fill(df: DataFrame, key: str, order_first: str, tiebreaks: Sequence[str],
                 fill_cols: Sequence[str], hot_keys: Sequence | None = (),
                 hot_min_rows: int = HOT_MIN_ROWS, chunk_rows: int = 1_000_000,
                 keep_spread: bool = False,
                 spread_cols: Sequence[str] | None = None) -> DataFrame:
    """Fill ``fill_cols`` forward within ``key`` in the order (order_first nulls
    last, *tiebreaks). ``key`` itself is never filled.

    ``keep_spread`` keeps the ``__spread`` partitioning column (see
    ``_window_fill``) for a following dedupe; it is null on keyed rows and a
    hash of ``spread_cols`` (default: all columns) on rows without a key.

    ``hot_keys``: keys to route through the chunked scan. ``()`` means none;
    ``"all"`` routes every key through it;
    ``None`` probes the data with :func:`find_hot_keys`.
    """
    fill_cols = [c for c in fill_cols if c != key]
    names = list(df.columns)
    df, tiebreaks = _with_tie(df, tiebreaks)
    spread_cols = spread_cols or names
    no_spread = F.lit(None).cast("long").alias(SPREAD)
    if isinstance(hot_keys, str):
        if hot_keys != "all":
            raise ValueError("hot_keys must be a sequence, None or 'all'")
        keyed = _chunked_fill(df.filter(F.col(key).isNotNull()), key, order_first, tiebreaks,
                              fill_cols, chunk_rows)
        nulls = df.filter(F.col(key).isNull())
        out = keyed.select("*", no_spread).unionByName(
            nulls.withColumn(SPREAD, F.xxhash64(*(spread_cols or nulls.columns))))
    else:
        if hot_keys is None:
            hot_keys = find_hot_keys(df, key, hot_min_rows)
        hot_keys = list(hot_keys)
        if not hot_keys:
            out = _window_fill(df, key, order_first, tiebreaks, fill_cols, spread_cols)
        else:
            is_hot = F.col(key).isin(hot_keys)
            cold = _window_fill(df.filter(~is_hot | F.col(key).isNull()), key, order_first,
                                tiebreaks, fill_cols, spread_cols)
            hot = _chunked_fill(df.filter(is_hot), key, order_first, tiebreaks, fill_cols,
                                chunk_rows)
            out = cold.unionByName(hot.select("*", no_spread))
    return out.select(*names, SPREAD) if keep_spread else out.select(*names)


def number_rows(df: DataFrame, key: str, order_cols: Sequence[str], out_col: str = "line_seq",
                hot_keys: Sequence | str | None = (), hot_min_rows: int = HOT_MIN_ROWS,
                range_partitions: int | None = None, range_rows: int = 1_000_000,
                nulls_last: Sequence[str] = (), null_keys: bool = True) -> DataFrame:
    """Position (1, 2, ...) of each row within its ``key`` group in the order
    ``order_cols`` (ascending, nulls first -- ``row_number`` semantics -- but
    last in the ``nulls_last`` columns).

    Ordinary keys use one ``row_number`` window. Hot keys (``None`` probes,
    ``"all"`` forces every key) are range-partitioned on (key, order), which
    splits a hot group into contiguous ranges of about ``range_rows`` rows
    (unless ``range_partitions`` gives their number); the ranges are written
    once to the checkpoint folder so their ids are stable, numbered locally,
    and shifted by the row counts of the earlier ranges of the same key (a
    prefix sum over one small row per range). Without ``null_keys`` (rows of a
    null key would be lost) the shift joins on the partitioning of the local
    numbering, so the rows are not shuffled for it.
    """
    order = [F.col(c).asc_nulls_last() if c in nulls_last else F.col(c).asc_nulls_first()
             for c in order_cols]
    if hot_keys is None:
        hot_keys = find_hot_keys(df, key, hot_min_rows)
    if isinstance(hot_keys, str):
        if hot_keys != "all":
            raise ValueError("hot_keys must be a sequence, None or 'all'")
        cold, hot = None, df
    else:
        hot_keys = list(hot_keys)
        if not hot_keys:
            cold, hot = df, None
        else:
            is_hot = F.col(key).isin(hot_keys)
            cold = df.filter(~is_hot | F.col(key).isNull())
            hot = df.filter(is_hot)
    parts = []
    if cold is not None:
        w = Window.partitionBy(key).orderBy(*order)
        parts.append(cold.withColumn(out_col, F.row_number().over(w).cast("long")))
    if hot is not None:
        if range_partitions is None:
            least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            range_partitions = max(least, -(-hot.count() // range_rows))
        ranged = materialize(
            hot.repartitionByRange(range_partitions, F.col(key).asc_nulls_first(), *order)
               .withColumn("__range", F.spark_partition_id()), "numbered_ranges")
        w_local = Window.partitionBy(key, "__range").orderBy(*order)
        local = ranged.withColumn("__rn", F.row_number().over(w_local))
        counts = ranged.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
        w_prev = (Window.partitionBy(key).orderBy("__range")
                  .rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select(F.col(key).alias("__key"), F.col("__range").alias("__r"),
                                F.coalesce(F.sum("__n").over(w_prev), F.lit(0)).alias("__off"))
        same_key = F.col(key).eqNullSafe(F.col("__key")) if null_keys else F.col(key) == F.col("__key")
        numbered = local.join(offsets, same_key & (F.col("__range") == F.col("__r"))) \
            .withColumn(out_col, (F.col("__off") + F.col("__rn")).cast("long"))
        parts.append(numbered.select(*df.columns, out_col))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
