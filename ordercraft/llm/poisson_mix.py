"""Mixing sources to target weights by Poisson replication, in DataFrame operations.

A source with n rows and target weight w gets the repetition rate
lambda = w * target / n. Each document draws a uniform number from a seeded
hash of its id and text and inverts the Poisson distribution of its source's
rate; it is then repeated that often and everything is shuffled by a seeded
hash. The expected mixture is exact for any rate, and a document's count
depends on nothing but its own key and its source's rate, so a recomputed
task draws the same copies.

Rates above ``MAX_RATE`` are split: a sum of m independent draws at lambda / m
has the same distribution, and each part has its own hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TMP, materialize
from .interleave import HASH_BITS, hash60

SEED = "mix-1"
TEMPERATURE = 0.7  # default target weight of a source: rows ** TEMPERATURE
MAX_RATE = 64.0
BROADCAST_BYTES = 8 << 20


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                 target_rows: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n_rows, weight, rate, parts, cdf) per source present.

    ``weights`` (source, weight) need not add up to 1; a source that it does
    not list has weight 0. Without it the weight is n_rows ** temperature.
    ``target_rows`` is the expected number of rows (default: as many as now)."""
    src = F.col(f"`{source_col}`").alias("source")
    counts = docs.groupBy(src).agg(F.count("*").alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("g")).agg(
            F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("w"))
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("g")), "left") \
                       .select("source", "n_rows", F.coalesce("w", F.lit(0.0)).alias("w"))
    counts = materialize(counts, "mix-counts")
    total = counts.agg(F.sum("n_rows").alias("rows"), F.sum("w").alias("w")).first()
    target = float(target_rows if target_rows is not None else total["rows"] or 0)
    rates = counts.withColumn("weight", F.col("w") / F.lit(float(total["w"] or 1.0) or 1.0)) \
        .withColumn("rate", F.col("weight") * F.lit(target) / F.col("n_rows"))
    part = F.col("rate") / F.col("parts")
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)))
    return rates.withColumn("lam", part).withColumn("cdf", F.expr(f"""
        CASE WHEN lam <= 0 THEN array(1.0D) ELSE
        aggregate(sequence(1, cast(ceil(lam + 12 * sqrt(lam) + 30) as int)),
          named_struct('logp', -lam, 'cdf', array(exp(-lam))),
          (a, k) -> named_struct('logp', a.logp + ln(lam) - ln(k), 'cdf',
            concat(a.cdf, array(element_at(a.cdf, -1) + exp(a.logp + ln(lam) - ln(k))))),
          a -> a.cdf) END""")).drop("lam", "w")


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
                target_rows: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` replicated to the target mixture, with ``copy`` (0, 1, ... per
    document; with a split rate the copies of one part follow those of the one
    before, with gaps) and ``mix_key`` (the seeded position in the global
    shuffle: partitions hold random rows, sorted by it).

    A null source is a source of its own. Null ids and texts count as empty;
    repeated rows draw the same count. A source of rate 0 gives no rows, an
    empty table none. Columns called copy or mix_key are replaced."""
    rates = materialize(source_rates(docs, weights, source_col, target_rows, temperature),
                        "mix-rates")
    size = rates.agg(F.sum(64 + F.size("cdf") * 8 + F.coalesce(F.octet_length(
        F.col("source").cast("string")), F.lit(0)))).first()[0] or 0
    side = rates.select(F.col("source").alias(f"{TMP}s"), F.col("parts").alias(f"{TMP}parts"),
                        F.col("cdf").alias(f"{TMP}cdf"))
    if size <= BROADCAST_BYTES:  # else a sort-merge join, which AQE splits on hot sources
        side = F.broadcast(side)
    names = [c for c in docs.columns if c not in ("copy", "mix_key")]
    base = docs.select(*[F.col(f"`{c}`") for c in names], hash60(
        F.lit(seed), F.col(f"`{id_col}`"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
        .alias(f"{TMP}key"))
    drawn = base.join(side, F.col(f"`{source_col}`").eqNullSafe(F.col(f"{TMP}s"))) \
        .withColumn(f"{TMP}part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{TMP}parts") - 1)))
    u = hash60(F.col(f"{TMP}key"), F.col(f"{TMP}part")) / F.lit(float(1 << HASH_BITS))
    drawn = drawn.withColumn(f"{TMP}u", u).withColumn(
        f"{TMP}count", F.expr(f"size(filter({TMP}cdf, c -> c <= {TMP}u))")) \
        .where(F.col(f"{TMP}count") > 0)
    copies = drawn.withColumn(f"{TMP}i", F.explode(F.sequence(F.lit(0), F.col(f"{TMP}count") - 1)))
    copies = copies.withColumn("copy", F.col(f"{TMP}part") * F.size(f"{TMP}cdf") + F.col(f"{TMP}i"))
    copies = copies.withColumn("mix_key", hash60(F.lit("shuffle"), F.col(f"{TMP}key"), F.col("copy")))
    return copies.select(*[F.col(f"`{c}`") for c in names], F.col("copy").cast("long").alias("copy"),
                         "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
