"""Sharding by proportional stratified interleaving, in DataFrame operations.

Rows of a source are put in a seeded random order; the row with rank r of n
has the fractional rank (r + phase) / n, where the phase in [0, 1) is drawn
from the source's name. Sorted by that number, every stretch of the order
holds each source in proportion, so equal cuts give shards that all match
the mixture.

Ranks are exact and no task ever holds a source: a row's order key falls into
one of ``BUCKETS`` equal ranges, the rows per (source, range) are counted
with partial aggregation, and a row's rank is the count of the earlier ranges
plus its number within its own. The global order is cut the same way over
ranges of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TMP, materialize

N_SHARDS = 40
SEED = "interleave-1"
BUCKETS = 1024  # ranges of the order key within a source
CUTS = 4096  # ranges of the fractional rank
HASH_BITS = 60


def hash60(*parts: Column) -> Column:
    """A 60-bit number from the MD5 of the parts (null: the empty text)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def interleave(rows: DataFrame, key_cols: list[str], source_col: str = "source",
               n_shards: int = N_SHARDS, seed: str = SEED) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0
    in each shard). Shard sizes differ by one row at most.

    ``key_cols`` identify a row and seed its place; rows that agree in all of
    them are interchangeable and take neighbouring places. Null keys count as
    empty text, a null source is a source of its own. An empty table gives an
    empty result. Columns called shard or slot are replaced, others pass
    unchanged. All columns travel through two shuffles, so hand in narrow rows
    (ids and sizes) and join the texts where they are needed."""
    h, s, b = f"{TMP}h", f"{TMP}s", f"{TMP}b"
    base = rows.drop("shard", "slot").withColumns({
        h: hash60(F.lit(seed), *[F.col(f"`{c}`") for c in key_cols]),
        s: F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("n"))})
    base = base.withColumn(b, F.shiftright(h, HASH_BITS - 10).cast("int"))
    ties = [h, *[f"`{c}`" for c in key_cols]]

    by_source = Window.partitionBy(s)
    counts = base.groupBy(s, b).agg(F.count("*").alias(f"{TMP}c"))
    counts = counts.select(
        s, b, F.sum(f"{TMP}c").over(by_source).alias(f"{TMP}n"),
        (F.sum(f"{TMP}c").over(by_source.orderBy(b)) - F.col(f"{TMP}c")).alias(f"{TMP}before"))
    ranked = base.join(counts, [s, b]).withColumn(
        f"{TMP}rank", F.col(f"{TMP}before") - 1
        + F.row_number().over(Window.partitionBy(s, b).orderBy(*ties)))
    phase = hash60(F.lit(seed), F.lit("phase"), F.col(s)) / F.lit(float(1 << HASH_BITS))
    f, cut = f"{TMP}f", f"{TMP}cut"
    ranked = ranked.withColumn(f, (F.col(f"{TMP}rank") + phase) / F.col(f"{TMP}n"))
    ranked = ranked.withColumn(cut, F.least(F.floor(F.col(f) * CUTS).cast("int"), F.lit(CUTS - 1)))
    ranked = materialize(ranked.drop(b, f"{TMP}n", f"{TMP}before", f"{TMP}rank"), "interleave")

    cuts = ranked.groupBy(cut).agg(F.count("*").alias(f"{TMP}c"))  # CUTS rows at most
    everything = Window.partitionBy(F.lit(0))
    cuts = cuts.select(
        cut, F.sum(f"{TMP}c").over(everything).alias(f"{TMP}n"),
        (F.sum(f"{TMP}c").over(everything.orderBy(cut)) - F.col(f"{TMP}c")).alias(f"{TMP}before"))
    placed = ranked.join(F.broadcast(cuts), cut).withColumn(
        f"{TMP}pos", F.col(f"{TMP}before") - 1
        + F.row_number().over(Window.partitionBy(cut).orderBy(f, *ties)))
    n, pos = F.col(f"{TMP}n"), F.col(f"{TMP}pos")
    placed = placed.withColumn("shard", F.expr(f"({TMP}pos * {n_shards}) div {TMP}n").cast("int"))
    first = F.expr(f"(shard * {TMP}n + {n_shards - 1}) div {n_shards}")  # ceiling
    return placed.withColumn("slot", pos - first) \
        .drop(h, s, f, cut, f"{TMP}n", f"{TMP}before", f"{TMP}pos")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED,
                    id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """Placement of every document: id, lang and source when present, size
    (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot,
    grown_shard. Null text counts as no bytes. The law is ``rows``; it fixes
    no growth, so grown_shard is null. Equal texts are placed one by one."""
    text = F.col(f"`{text_col}`")
    extra = [c for c in ("lang",) if c in docs.columns]
    narrow = docs.select(
        F.col(f"`{id_col}`"), *extra, F.col(f"`{source_col}`"),
        (F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    placed = interleave(materialize(narrow, "sizes"), [id_col, "size", "text_crc32"],
                        source_col, n_shards, seed)
    return placed.select(F.col(f"`{id_col}`"), *extra, F.col(f"`{source_col}`"), "size",
                         "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
