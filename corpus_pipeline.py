"""The corpus pipeline: five stages from documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlens.llm import jaccard, language_id, mixing, packing, suffix_dedup
from rosterlens.llm.common import hand_out, table
from rosterlens.llm.queries import LIMIT, PACKED_WITH
from rosterlens.sources.scratch import Scratch


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the language classifier rejects go."""
    hand_out(spark)
    return language_id.accepted(docs, language_id.fit(docs, F.lit(True)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    hand_out(spark)
    groups = jaccard.similar_groups(docs.select("doc_id", "text"))
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id",
                     "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that stand earlier in the corpus; emptied documents go."""
    hand_out(spark)
    found = suffix_dedup.dedup(docs.select("doc_id", "text")).where("n_removed > 0").select(
        "doc_id", "copy", "kept_text").dropDuplicates(["doc_id"])
    text = F.when(F.col("copy"), "").otherwise(F.coalesce("kept_text", "text"))
    cut = docs.join(found, "doc_id", "left").withColumn("_cut", F.col("copy").isNotNull())
    return (cut.withColumn("text", text).where(~F.col("_cut") | (F.length("text") > 0))
            .withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long"))
                        .otherwise(F.col("n_chars"))).select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files, and rows in them, follow its slots."""
    # ids, sources and a hash are ranked; the rest of a row is joined once. Rows alike in all
    # columns take their places one by one from one copy.
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              "_copy": F.xxhash64(*docs.columns)})
    places = mixing.mixed_order(keyed.select("doc_id", "source", "_id", "_copy"),
                                mixing.square_root_weights(docs), "_id", "_copy")
    rows = keyed.groupBy("_id", "_copy").agg(*(F.first(c).alias(c) for c in docs.columns))
    return rows.join(places.select("_id", "_copy", "slot", "place"), ["_id", "_copy"]) \
        .repartitionByRange("slot").sortWithinPartitions("slot", "place").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences, which follow the mix."""
    hand_out(spark)
    return packing.pack_documents(packing.in_file_order(docs), public_tokenizers.path(PACKED_WITH), LIMIT)


STAGES = [("language_id", recognised), ("ngram_jaccard", one_of_each_group),
          ("suffix_array_dedup", without_repeats), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir))
            scratch.drop_all_but(docs)
        return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # tokens and learned languages are not for SQL; see tests/llm
