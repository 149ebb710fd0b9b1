"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; ``run`` writes every stage's result to the shared
checkpoint folder and reads it back as the next one's documents. All stages
but the last return the columns of documents. An empty table passes through
all of them; null ids, texts, languages and sources are handled as the
operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercraft.llm import decontaminate, interleave, order_minhash, poisson_mix, ppm_langid
from ordercraft.llm.common import TMP, materialize, table

MIN_LANGUAGE_SCORE = 0.5  # posterior of the likeliest language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognisable language: ``und`` (no letter, null) and texts
    without a likelier language than all others together go."""
    out = f"{TMP}ppm"
    d = ppm_langid.identify(docs, F.lit(True), out=out)
    keep = (F.col(f"{out}.lang") != ppm_langid.UNKNOWN) & (F.col(f"{out}.score") >= MIN_LANGUAGE_SCORE)
    return d.where(keep).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return order_minhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights, in shuffled order. Columns that bear
    the operator's names in any case are set aside and come back as they were."""
    aside = {c: f"{TMP}own_{c}" for c in docs.columns if c.lower() in ("copy", "mix_key")}
    mixed = poisson_mix.poisson_mix(docs.withColumnsRenamed(aside))
    return mixed.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return interleave.shard_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

# Trained trees, hashed sketches and suffix search have no SQL form; the tests
# hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
