"""Stored vectors with the query vector they are compared with: one folder, two tables.

``<path>/vectors`` holds ``(id, vector array<float>)``, ``<path>/query`` one row
``(vector array<float>)``. The query is written last and marks the artifact as complete.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlens.operators.dense import dense_cosine, one_per_key
from rosterlens.sources.candidates import _exists


@dataclass(frozen=True)
class VectorArtifact:
    """``vectors`` is ``(id, vector)``; ``query`` the vector of the role text."""

    vectors: DataFrame
    query: tuple[float, ...]

    def similarities(self) -> DataFrame:
        """``(candidate_id, dense)``: cosine with the query, one row an id."""
        near = dense_cosine(self.vectors.withColumnRenamed("id", "candidate_id"), "candidate_id",
                            "vector", self.query)
        return one_per_key(near, "candidate_id")


def write_vectors(vectors: DataFrame, query: Sequence[float], path: str) -> None:
    """Write ``(id, vector)`` rows and the query vector; ids keep their full length."""
    spark = vectors.sparkSession
    vectors.select(F.col("id").cast("string").alias("id"),
                   F.col("vector").cast("array<float>").alias("vector")).write.parquet(
        f"{path}/vectors")
    one = spark.createDataFrame([([float(x) for x in query],)], "vector array<float>")
    one.write.parquet(f"{path}/query")


def read_vectors(spark: SparkSession, path: str | None) -> VectorArtifact | None:
    """The artifact at ``path``, or ``None`` where there is none: vectors are optional.

    One without its query vector was not written to its end and is an error.
    """
    if not path or not _exists(spark, path):
        return None
    query = None
    if _exists(spark, f"{path}/query"):
        query = spark.read.schema("vector array<float>").parquet(f"{path}/query").first()
    if query is None:
        raise ValueError(f"the vectors at {path} have no query vector")
    rows = spark.read.schema("id string, vector array<float>").parquet(f"{path}/vectors")
    return VectorArtifact(rows, tuple(query["vector"]))


def dense_of(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Similarities from the artifact at ``path``, ``None`` where there is none."""
    artifact = read_vectors(spark, path)
    return None if artifact is None else artifact.similarities()
