"""Rows at positions of a sorted table, without sorting it in one place.

The table is range-partitioned by the order and written once; one count per
partition says which partition holds a position and where in it. Only these
partitions are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

POSITION = "position"


def rows_at(df: DataFrame, positions: Sequence[int], order_cols: Sequence[str],
            out_col: str = POSITION) -> DataFrame:
    """The rows at ``positions`` (1 is the first, -1 the last) in ascending order
    of ``order_cols`` (nulls first), with their position from the start; positions
    outside the table give no row. Rows that tie in ``order_cols`` are ordered by
    a hash of the row. The driver sees one count per partition."""
    names = list(df.columns)
    order = [*[F.col(f"`{c}`").asc_nulls_first() for c in order_cols], F.col("__tie")]
    ranged = materialize(df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in names]))
                         .repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "positions")
    counts = sorted((r["__range"], r["n"]) for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    wanted = sorted({p if p > 0 else total + 1 + p for p in positions if p})
    targets, before = [], 0
    for part, n in counts:
        targets += [(part, p - before, p) for p in wanted if before < p <= before + n]
        before += n
    at = F.lit(None).cast("long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    rows = ranged.where(F.col("__range").isin(sorted({t[0] for t in targets}))).withColumn("__place", place)
    for part, k, p in targets:
        at = F.when((F.col("__range") == part) & (F.col("__place") == k), F.lit(p).cast("long")).otherwise(at)
    return rows.withColumn(out_col, at).where(F.col(out_col).isNotNull()).select(*[F.col(f"`{c}`") for c in names], out_col)
