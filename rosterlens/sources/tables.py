"""Role texts and the result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """``(jd_id, text)``: one role description per file, whole file as text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("jd_id"), F.col("value").alias("text"))


def ranked_output(ranked: DataFrame) -> DataFrame:
    """The four output columns, the score with four decimals."""
    return ranked.select("candidate_id", "rank",
                         F.format_string("%.4f", "score").alias("score"), "reasoning")


def write_ranked_csv(ranked: DataFrame, path: str, top: int | None = None,
                     single_file: bool = False) -> None:
    """Ranked rows as CSV with a header, best first.

    Rows stay in range-sorted part files that concatenate in order; with
    ``single_file`` one task writes them all.
    """
    if top is not None:
        ranked = ranked.orderBy("rank").limit(top)
    else:
        ranked = ranked.orderBy("rank")
    out = ranked_output(ranked)
    if single_file:
        out = out.coalesce(1).sortWithinPartitions(F.col("rank"))
    out.write.option("header", True).option("escape", '"').csv(path)


def write_audit_json(audit: DataFrame, path: str) -> None:
    audit.write.json(path)


def read_ranked_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a ranking back with its types."""
    schema = "candidate_id STRING, rank INT, score STRING, reasoning STRING"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
