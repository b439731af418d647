"""Exact TF-IDF cosine of a role text against a corpus of counted terms.

The corpus is the table of text features (see ``text_features``): tokenised once, read twice.

1. terms are merged over the corpus, combined in every task first, into document and corpus
   frequencies;
2. each row's terms meet the vocabulary and give partial sums of its dot product and norm; what
   is shuffled is one partial sum per document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlens.operators.ordering import exact_percentile
from rosterlens.operators.text_features import stop_words, with_terms
from rosterlens.settings import Settings
from rosterlens.sources.scratch import Scratch, materialise

COMMON_TERMS = 200_000   # looked up where terms are read, when the vocabulary has no cap


def counted(features: DataFrame, key: str) -> DataFrame:
    """``(key, term, tf)`` of the counted terms."""
    return features.select(key, F.inline("terms"))


def role_terms(roles: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """``(key, term, tf)`` of role texts."""
    return counted(with_terms(roles, text, stop_words(settings)), key)


def frequencies(counts: DataFrame) -> DataFrame:
    """``(term, df, cf)`` of ``(term, tf)`` rows, one a document and term."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def most_frequent(terms: DataFrame, most: int) -> DataFrame:
    """The ``most`` terms by corpus frequency of a written table; ties at the cut go by term.

    The frequency at the cut is found from the count of terms of each frequency; only terms that
    have just this one are put in order.
    """
    above = F.sum("n").over(Window.orderBy(F.desc("cf"))) - F.col("n")
    cut = (terms.groupBy("cf").agg(F.count(F.lit(1)).alias("n"))
           .select("cf", above.alias("above")).where(F.col("above") < most)
           .agg(F.min_by(F.struct("cf", "above"), "cf").alias("cut")).first()["cut"])
    if cut is None:
        return terms
    ties = terms.where(F.col("cf") == cut["cf"]).orderBy("term").limit(most - cut["above"])
    return terms.where(F.col("cf") > cut["cf"]).unionByName(ties)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def weight(tf: Column, idf_of: Column) -> Column:
    return (1.0 + F.log(tf.cast("double"))) * idf_of


def similarities(features: DataFrame, key: str, role_text: str, settings: Settings,
                 pool: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``(key, tfidf)`` for every document; no shared term gives 0.

    ``features`` is a written table of ``key`` (unique) and ``terms``. ``pool`` may name more
    documents than have terms. The role text is one document of the fitted corpus.
    """
    spark = features.sparkSession
    keep = materialise if scratch is None else scratch.keep
    docs = (features if pool is None else pool).select(key)
    role = role_terms(spark.range(1).select(F.lit(role_text).alias("_text"),
                                            F.lit(0).alias("_role")), "_role", "_text", settings)
    counts = counted(features, key)
    n_docs = docs.agg((F.count(F.lit(1)) + 1).alias("n")).scalar()
    terms = keep(frequencies(counts.select("term", "tf").unionByName(role.select("term", "tf")))
                 .where(F.col("df") >= settings.min_df))
    kept = terms if settings.max_features is None else most_frequent(terms, settings.max_features)
    kept = kept.select("term", idf(n_docs, F.col("df")).alias("idf"), "df")

    asked = role.join(kept, "term").select("term", weight(F.col("tf"), F.col("idf")).alias("_w"))
    length = asked.agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l")).scalar()
    # the terms of one text, which the driver holds
    wanted = kept.join(F.broadcast(asked), "term", "left").select(
        "term", "idf", F.coalesce(F.col("_w") / length, F.lit(0.0)).alias("_q"), "df")
    # a written vocabulary shows its size: a capped one meets the terms where they are read
    if settings.max_features is not None:
        met = counts.join(keep(wanted.drop("df")), "term")
    else:
        met = _met(counts, wanted, terms, keep)
    sums = (met.select(key, weight(F.col("tf"), F.col("idf")).alias("_w"), "_q")
            .groupBy(key)
            .agg(F.sum(F.col("_w") * F.col("_q")).alias("_dot"),
                 F.sum(F.col("_w") * F.col("_w")).alias("_sq")))
    hit = sums.where("_dot > 0").select(key, (F.col("_dot") / F.sqrt("_sq")).alias("tfidf"))
    return docs.join(hit, key, "left").select(key, F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def _met(counts: DataFrame, wanted: DataFrame, terms: DataFrame, keep: Callable) -> DataFrame:
    """``counts`` joined with a vocabulary of any size.

    The ``COMMON_TERMS`` most frequent terms, about half of all that are counted, are looked up
    where they are read; only what is left is exchanged to meet the rest of the vocabulary.
    """
    common = keep(most_frequent(terms, COMMON_TERMS).select("term", F.lit(True).alias("_common")))
    marked = wanted.join(common, "term", "left")
    near = keep(marked.where("_common").select("term", "idf", "_q"))
    rare = marked.where(F.col("_common").isNull()).select("term", "idf", "_q")
    return counts.join(near, "term").unionByName(
        counts.join(near.select("term"), "term", "left_anti").join(rare, "term"))


def scale_percent(n: Column, settings: Settings) -> Column:
    """Percentile that counts as 1: the maximum for few rows."""
    return F.when(n >= settings.scale_min_rows, settings.scale_percentile).otherwise(100.0)


def scaled_by(value: Column, top: Column) -> Column:
    """Divided by ``top``, clipped to 0..1; 0 where the top is nothing."""
    return F.when(top <= 1e-9, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / top)))


def percentile_scaled(sims: DataFrame, column: str, out: str, settings: Settings,
                      scratch: Scratch | None = None) -> DataFrame:
    """Divide by the 99th percentile (the maximum below 50 rows), clip to 0..1."""
    top = exact_percentile(sims, column, scale_percent(F.col("n"), settings), scratch).select(
        "value").scalar()
    return sims.withColumn(out, scaled_by(F.col(column), top))
