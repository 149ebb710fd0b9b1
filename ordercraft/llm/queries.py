"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from . import (decontaminate, ef_trie_lm, forced_bpe, interleave, kneser_ney, merkle_manifest, order_minhash,
               poisson_mix, ppm_langid, prefix_trie, pruned_graph, token_histogram, toxicity)
from .common import crc_bucket, table
from .oracles import ORACLE  # noqa: F401  (read by the entry file)


def op1_suffix_decontamination(spark, sf_dir):
    """Per document: words, words inside benchmark windows, items, verdict."""
    d = decontaminate.annotate_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return d.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"),
        decontaminate.hit_words().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"))


def op2_length_histogram(spark, sf_dir):
    """Documents per encoded length with prefix, suffix and truncated totals."""
    return token_histogram.length_histogram(table(spark, sf_dir, "documents"))


def op3_kneser_ney(spark, sf_dir):
    """Perplexity of every document under a model of trusted text, and the verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.classify(docs, docs, keep=["doc_id", "lang"], ids=labels.where("quality = 1").select("doc_id"))


def op4_stratified_interleaving(spark, sf_dir):
    """Shard and slot of every document under the law ``rows``."""
    return interleave.shard_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    """Toxicity of every document; learned where crc32(doc_id) mod 5 is not 0."""
    held = crc_bucket("doc_id", 5) == 0
    return toxicity.score(table(spark, sf_dir, "documents").withColumn("held_out", held),
                          table(spark, sf_dir, "labels"), ~F.col("held_out"),
                          keep=["doc_id", "held_out"])


def op6_poisson_mixture(spark, sf_dir):
    """Every document repeated by its Poisson draw, in shuffled order."""
    return poisson_mix.poisson_mix(table(spark, sf_dir, "documents"))


def op7_trie_scores(spark, sf_dir):
    """Model and base score of every document; learned where crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    d = ef_trie_lm.score(docs, crc_bucket("doc_id", 5) != 1)
    return d.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens",
                    "n_known", "train_tokens", "base_score", "score")


def op8_order_minhash(spark, sf_dir):
    """Class of every document: smallest id of its near copies, and whether it stays."""
    return order_minhash.classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "kept", F.col("n").alias("n_shingles"))


def op9_pruned_graph(spark, sf_dir):
    """Links, component and verdict of every vector at cosine 0.95."""
    d = pruned_graph.links(table(spark, sf_dir, "embeddings"))
    return d.withColumnRenamed("id", "vec_id")


def op10_ppm_language(spark, sf_dir):
    """Language of every document; learned where crc32(doc_id) mod 3 is not 1."""
    held = crc_bucket("doc_id", 3) == 1
    d = ppm_langid.identify(table(spark, sf_dir, "documents").withColumn("held_out", held),
                            ~F.col("held_out"), keep=["doc_id", "held_out"])
    return d.select("doc_id", "held_out", F.col("ppm.lang").alias("lang_pred"),
                    F.col("ppm.score").alias("score"))


def op11_merkle_manifest(spark, sf_dir):
    """Leaf, roots, proof and recomputed root of every document; where 5 divides
    crc32(doc_id), a version with the text's A-Z in lower case."""
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(crc_bucket("doc_id", 5) == 0, merkle_manifest.leaf_digest([*rest, lower]))
    d = merkle_manifest.manifest(docs.select(
        F.col("doc_id").alias("id"), "source", merkle_manifest.leaf_digest([*rest, F.col("text")]).alias("leaf"),
        changed.alias("changed")))
    return d.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_prefix_trie(spark, sf_dir):
    """Nodes of the trie over the rebuilt conversations with their subtree totals."""
    turns = prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuild(turns))


def op13_forced_boundary_bpe(spark, sf_dir):
    """Number and digest of every document's token ids, and digest of what they decode to."""
    d = forced_bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("doc_id", F.floor(F.octet_length("bpe.ids") / 4).alias("n_tokens"),
                    F.sha2("bpe.ids", 256).alias("ids_sha256"),
                    F.sha2(F.encode("bpe.decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_decontamination, op2_length_histogram, op3_kneser_ney, op4_stratified_interleaving, op5_toxicity,
    op6_poisson_mixture, op7_trie_scores,
    op8_order_minhash, op9_pruned_graph, op10_ppm_language, op11_merkle_manifest,
    op12_prefix_trie, op13_forced_boundary_bpe)}
