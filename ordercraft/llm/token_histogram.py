"""Token counts by an exact length histogram.

Every document is encoded whole with a public byte-level BPE vocabulary; the
documents are counted per encoded length (partial aggregation; at most one
row per distinct length reaches the shuffle from each task). Prefix and
suffix sums over the histogram then answer totals, quantiles and truncated
totals for every context limit. The sums go in two levels of blocks of
lengths, so no task reads the whole histogram.

Null and empty texts have length 0; repeated rows count each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TMP, annotate, materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 64  # lengths in a block of the two-level sums


def load_encoding(path: str | None = None):
    """The vocabulary at ``path`` (default: the installed public one)."""
    import base64

    import public_tokenizers
    import tiktoken
    path = path or public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def token_lengths(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                  vocabulary: str | None = None, out: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``out`` holding ``n``, the encoded length."""

    def make():
        enc = load_encoding(vocabulary)

        def work(text):
            return [pa.array(np.array([len(enc.encode_ordinary(t)) if t else 0
                                       for t in text.to_pylist()], np.int64))]
        return work

    return annotate(docs, text_col, make, "n long", out, keep, chunk_bytes=2 << 20)


def length_histogram(docs: DataFrame, text_col: str = "text",
                     vocabulary: str | None = None) -> DataFrame:
    """One row per distinct encoded length: ``length``, ``n_docs``, ``n_tokens``
    (of these documents), ``docs_upto`` and ``tokens_upto`` (documents at most
    that long), ``docs_over`` (longer ones), ``truncated_tokens`` (total if
    every document is cut to this length) and ``share_upto``."""
    lengths = token_lengths(docs, text_col, [], vocabulary, f"{TMP}t")
    hist = lengths.groupBy(F.col(f"{TMP}t.n").alias("length")).agg(F.count("*").alias("n_docs"))
    hist = materialize(hist, "lengths")  # used twice below; the texts are encoded once
    hist = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")) \
               .withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    whole, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("block")
    blocks = blocks.select(
        F.col("block").alias("b"), F.sum("d").over(whole).alias("all_docs"),
        (F.sum("d").over(upto) - F.col("d")).alias("d0"),
        (F.sum("t").over(upto) - F.col("t")).alias("t0"))
    inner = Window.partitionBy("block").orderBy("length")
    hist = hist.join(blocks, F.col("block") == F.col("b")) \
        .withColumn("docs_upto", F.col("d0") + F.sum("n_docs").over(inner)) \
        .withColumn("tokens_upto", F.col("t0") + F.sum("n_tokens").over(inner)) \
        .withColumn("docs_over", F.col("all_docs") - F.col("docs_upto"))
    return hist.select(
        "length", "n_docs", "n_tokens", "docs_upto", "tokens_upto", "docs_over",
        (F.col("tokens_upto") + F.col("docs_over") * F.col("length")).alias("truncated_tokens"),
        (F.col("docs_upto") / F.col("all_docs")).alias("share_upto"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: ``n_tokens`` of all documents cut to ``limit`` tokens."""
    return hist.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")),
                               F.lit(0)).alias("n_tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the smallest ``length`` that a share of at least q does not exceed."""
    return hist.where(F.col("share_upto") >= q - 1e-12).agg(F.min("length").alias("length"))
