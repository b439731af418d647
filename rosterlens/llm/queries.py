"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlens.llm import (alignment, ctw, host_rules, jaccard, language_id, mixing, packing,
                            quality, substrings, suffix_dedup, token_counts, vector_codes, vectors)
from rosterlens.llm.common import doc_crc, table
from rosterlens.llm.oracle import ORACLE

PACKED_WITH = "byte_bpe_50k.json"
COUNTED_WITH = "word_bpe_49k.json"
ALIGNED_WITH = "piece_bpe_32k.model"
LIMIT = 2048


def held_out(modulus: int, remainder: int):
    return F.coalesce(doc_crc(modulus) == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = held_out(3, 1)
    model = language_id.fit(docs, ~out)
    return language_id.predict(docs, model).withColumn("held_out", out).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_context_tree_weighting(spark: SparkSession, sf: str) -> DataFrame:
    return ctw.score(table(spark, sf, "documents").select("doc_id", "text"), held_out(10, 0))


def op3_best_two_fit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(PACKED_WITH), LIMIT)


def op4_token_group_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id")


def op5_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return host_rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op6_cover_tree(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf, "embeddings"))


def op7_pfair_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mixing.mixed_order(docs, mixing.square_root_weights(docs))


def op8_seed_and_extend(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.repeats(table(spark, sf, "documents").select("doc_id", "text"))


def op9_interval_expansion(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                           "kept_sha256")


def op10_whole_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"),
                                     public_tokenizers.path(COUNTED_WITH), LIMIT)


def op11_ball_kmeans_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_incidence_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(
        table(spark, sf, "documents"), public_tokenizers.path(PACKED_WITH),
        public_tokenizers.path(ALIGNED_WITH)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
        "n_shared")


def op13_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, out = table(spark, sf, "documents").select("doc_id", "text"), held_out(3, 1)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels, ~out))
    return scored.select("doc_id", out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_context_tree_weighting, op3_best_two_fit, op4_token_group_join,
    op5_host_rules, op6_cover_tree, op7_pfair_mix, op8_seed_and_extend, op9_interval_expansion,
    op10_whole_token_counts, op11_ball_kmeans_codes, op12_incidence_alignment,
    op13_subword_quality)}
__all__ = ["ORACLE", "QUERIES"]
