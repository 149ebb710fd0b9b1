"""Nested subtotals (A9-A12, Q28) and period differences.

For keys k1..kn the levels are (k1), (k1,k2), ..., (k1..kn). The rows are
aggregated once on all keys; the upper levels come from those partial states
(one ``groupingSets`` pass whose Expand stands above the aggregate, so it
multiplies groups, not raw rows). Aggregated-away keys read ``[Total]``.
There is no grand-total level. A null in a lower key still counts in the
upper levels but has no row of its own; a null first key is dropped.

Period differences come in long form: a dense grid of keys and periods (a
period that a key lacks stays null) and ``lag``; the wide forms are pivots of
the written long form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# The label of an aggregated-away key, and the period switches.
TOTAL_LABEL = "[Total]"
PERIOD_ALL, PERIOD_TO_DATE = "yoy", "ytd"


def _parts(df: DataFrame, col: str, how: Callable | None) -> tuple | None:
    """(partial aggregates, combination of their names) of an aggregate that can be
    taken level by level; None for one that cannot."""
    if how is None:  # a sum over nulls only is 0
        return [F.sum(col)], lambda p: F.coalesce(F.sum(p[0]), F.lit(0))
    if how in (F.sum, F.min, F.max):
        return [how(col)], lambda p: how(p[0])
    if how is F.count:
        return [F.count(col)], lambda p: F.sum(p[0])
    if how in (F.avg, F.mean):
        kind = df.select(F.avg(col)).schema[0].dataType
        wide = "double" if isinstance(kind, T.DoubleType) else None
        total = F.sum(F.col(col).cast(wide)) if wide else F.sum(col)
        return [total, F.count(col)], lambda p: F.try_divide(F.sum(p[0]), F.sum(p[1])).cast(kind)
    return None


def _levels(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """``aggs`` per level, with a flag ``__g_<key>`` for each aggregated-away key."""
    sets = [keys[:i] for i in range(1, len(keys) + 1)]
    g = df.groupingSets(sets, *keys).agg(*aggs, *[F.grouping(k).alias(f"__g_{k}") for k in keys[1:]])
    keep = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        keep = keep & ((F.col(f"__g_{k}") == 1) | F.col(k).isNotNull())
    return g.filter(keep)


def _distinct_levels(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct count of ``value`` per level, flagged as in ``_levels``: each
    level's distinct rows come from those of the level below, which are written
    once, so rows are neither multiplied nor grouped together with their copies."""
    rows, levels = df.select(*keys, value).distinct(), []
    for i in range(len(keys), 0, -1):
        rows = materialize(rows, "distinct_level") if i > 1 else rows
        keep = F.lit(True)
        for k in keys[:i]:
            keep = keep & F.col(k).isNotNull()
        counted = rows.filter(keep).groupBy(*keys[:i]).agg(F.count(value).alias(value))
        levels.append(counted.select(
            *[F.col(k) if j < i else F.lit(None).cast(df.schema[k].dataType).alias(k) for j, k in enumerate(keys)], value,
            *[F.lit(int(j >= i)).cast("byte").alias(f"__g_{k}") for j, k in enumerate(keys) if j]))
        rows = rows.select(*keys[:i - 1], value).distinct()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def subtotals(df: DataFrame, value_cols: str | Sequence[str], keys: Sequence[str],
              total_label: str = TOTAL_LABEL,
              aggregates: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """Long-form nested subtotals of one or several columns.

    ``aggregates`` names the aggregate of a value column (``F.max``, ``F.avg``,
    ``F.count_distinct`` ...); a column without one is summed, where a sum over
    nulls only is 0. Sums, counts, averages, minima and maxima are combined from
    the lowest level; distinct counts start from the distinct (keys, value) rows,
    level by level, and any other aggregate from the rows, each apart. Needs at least two keys
    (with one there is nothing to nest).
    """
    keys = list(keys)
    if len(keys) < 2:
        raise ValueError("subtotals need at least two keys")
    values = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    how = aggregates or {}
    lowest, combined, frames = [], [], []
    for i, v in enumerate(values):
        split = _parts(df, v, how.get(v))
        if split is not None:
            names = [f"__p{i}_{j}" for j in range(len(split[0]))]
            lowest += [a.alias(n) for a, n in zip(split[0], names)]
            combined.append(split[1](names).alias(v))
        else:
            frames.append(_distinct_levels(df, keys, v) if how[v] in (F.count_distinct, F.countDistinct)
                          else _levels(df, keys, [how[v](v).alias(v)]))
    if combined:
        frames.insert(0, _levels(df.groupBy(*keys).agg(*lowest), keys, combined))
    flags = [f"__g_{k}" for k in keys[1:]]
    out = frames[0]
    for f in frames[1:]:
        on = [*keys, *flags]
        other = f.withColumnsRenamed({c: f"__r_{c}" for c in on})
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        out = out.join(other, cond).drop(*[f"__r_{c}" for c in on])
    labelled = [F.col(keys[0])] + [
        F.when(F.col(f"__g_{k}") == 1, F.lit(total_label))
         .otherwise(F.col(k).cast("string")).alias(k) for k in keys[1:]]
    return out.select(*labelled, *values)


MAX_PIVOT_COLUMNS = 2_000


def distinct_values(df: DataFrame, col: str, limit: int = MAX_PIVOT_COLUMNS) -> list:
    """Sorted distinct values of a pivot column: each becomes a column of the
    result, so they are the one thing of the data that planning has to know.
    More than ``limit`` are refused (the long form holds any number)."""
    rows = df.select(col).distinct().filter(F.col(col).isNotNull()).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values: use the long form")
    return sorted(r[0] for r in rows)


def subtotals_wide(df: DataFrame, value_col: str, keys: Sequence[str],
                   pivot_values: Sequence | None = None,
                   total_label: str = TOTAL_LABEL) -> DataFrame:
    """A10: the subtotals with the first key turned into columns. Without
    ``pivot_values`` the long form is written once; columns come from its rows."""
    keys = list(keys)
    long = subtotals(df, value_col, keys, total_label)
    if pivot_values is None:
        long = materialize(long, "subtotals")
        pivot_values = distinct_values(long, keys[0])
    wide = long.groupBy(*keys[1:]).pivot(keys[0], list(pivot_values)).agg(F.first(value_col))
    return wide.orderBy(*keys[1:])  # L4: '[Total]' sorts after capitals, before lower case


def dense_periods(long: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """``long`` (one row per keys and period) on the full grid of its keys and
    periods; a missing cell has null values. The periods are one aggregate row,
    read as a scalar subquery; no cross join."""
    keys = list(keys)
    axis = long.agg(F.sort_array(F.collect_set(period)).alias("periods"))
    grid = long.select(*keys).distinct().select(*keys, F.explode(axis.scalar()).alias(period))
    right = long.withColumnsRenamed({c: f"__r_{c}" for c in [*keys, period]})
    cond = F.col(period) == F.col(f"__r_{period}")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return grid.join(right, cond, "left").drop(*[f"__r_{c}" for c in [*keys, period]])


def previous_period(dense: DataFrame, keys: Sequence[str], period: str, value: str) -> Column:
    """The value of the period before, within a dense grid (null in the first one)."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(period))


def period_differences(long: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """W6 in long form: each period's value (0 where missing), the difference to
    the period before and the ratio minus 1 (null in the first period, and where
    the earlier value is 0)."""
    dense = dense_periods(long, keys, period).fillna(0, subset=[value])
    prev = previous_period(dense, keys, period, value)
    return dense.withColumns({
        "difference": F.col(value) - prev,
        "difference_pct": F.try_divide(F.col(value).cast("double"), prev.cast("double")) - F.lit(1.0)})


def period_filter(df: DataFrame, date_switch: str, date_col: str, month: int) -> DataFrame:
    """``yoy`` keeps all rows, ``ytd`` rows in months 1..``month``."""
    if date_switch == PERIOD_ALL:
        return df
    if date_switch == PERIOD_TO_DATE:
        return df.filter(F.month(date_col) <= month)
    raise ValueError(f"date_switch must be {PERIOD_ALL!r} or {PERIOD_TO_DATE!r}")


def subtotals_by_period(df: DataFrame, date_switch: str, date_col: str, month: int,
                        value_col: str, keys: Sequence[str],
                        pivot_values: Sequence | None = None) -> DataFrame:
    """Subtotals whose first key is a period, year-over-year or year-to-date."""
    return subtotals_wide(period_filter(df, date_switch, date_col, month), value_col, keys,
                          pivot_values)


def diff_and_percent(df: DataFrame, period_cols: Sequence[str]) -> DataFrame:
    """W6 (Q29): fill the period columns' nulls with 0, then the last period
    minus the one before and the ratio minus 1 (null where the earlier period
    is 0, instead of inf / NaN)."""
    period_cols = list(period_cols)
    if len(period_cols) < 2:
        raise ValueError("need at least two period columns")
    filled = df.fillna(0, subset=period_cols)
    last, prev = F.col(period_cols[-1]), F.col(period_cols[-2])
    return filled.withColumns({
        "difference": last - prev,
        "difference_pct": F.try_divide(last.cast("double"), prev.cast("double")) - F.lit(1.0),
    })
