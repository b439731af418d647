"""Aggregates over ranked rows. All group keys combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def kpis(audit_rows: DataFrame, country: str) -> DataFrame:
    """Count, share of one country (whole percent), flagged, mean years of the top 10."""
    home = F.coalesce((F.col("country") == country).cast("int"), F.lit(0))
    return audit_rows.agg(
        F.count(F.lit(1)).alias("candidates"),
        (F.sum(home) / F.count(F.lit(1)) * 100).cast("int").alias("home_percent"),
        F.count_if("honeypot").alias("flagged"),
        F.avg(F.when(F.col("rank") <= 10, F.col("yoe"))).alias("top10_yoe"))


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts by value."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(column)).limit(k))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """Equal-width bins between minimum and maximum; empty bins are absent."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(column) - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return (df.where(F.col(column).isNotNull())
            .select(F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))


def scatter(audit_rows: DataFrame) -> DataFrame:
    return audit_rows.select("candidate_id", "title", "yoe", "score", "role_fit")


def experience_bands(df: DataFrame) -> DataFrame:
    yoe = F.col("yoe")
    band = (F.when(yoe.between(6, 8), "6-8").when(yoe.between(5, 9), "5-9")
            .when(yoe < 5, "<5").otherwise("9+"))
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("count"))


def score_range(audit_rows: DataFrame) -> DataFrame:
    """Lowest and highest score with the number of flagged rows."""
    return audit_rows.agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"),
                          F.count_if("honeypot").alias("flagged"))


def leaders(audit_rows: DataFrame, k: int = 5) -> DataFrame:
    return audit_rows.orderBy("rank").limit(k)
