"""Dense-vector cosine and its optional blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.functions.lexicon import dot

EPS = 1e-9


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x)) + F.lit(EPS)


def dense_cosine(vectors: DataFrame, key: str, vector: str,
                 query: Sequence[float]) -> DataFrame:
    """``(key, dense)``: cosine of every stored vector with the query vector."""
    v = F.col(vector).cast("array<double>")
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, (dot(v, q) / (_length(v) * _length(q))).alias("dense"))


def one_per_key(sims: DataFrame, key: str, column: str = "dense") -> DataFrame:
    """A stored id is looked up like in a dictionary: one value per id.

    Equal ids are merged in every task before the shuffle. Which of several
    differing vectors wins is undefined in an unordered table; the largest
    similarity is taken so that the result does not depend on file order.
    """
    return sims.groupBy(key).agg(F.max(column).alias(column))
