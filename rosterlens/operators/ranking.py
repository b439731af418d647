"""Normalise, cut and number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rosterlens.functions.basics import grid
from rosterlens.operators.ordering import number_rows
from rosterlens.sources.scratch import Scratch


def normalised(scored: DataFrame) -> DataFrame:
    """``score``: final over the largest final, four decimals, half to even.

    The maximum is a scalar subquery over one column of ``scored``; pass a
    written table so that it does not repeat the scoring.
    """
    top = scored.agg(F.max("final")).scalar()
    divisor = F.when(top == 0.0, F.lit(1.0)).otherwise(top)
    return scored.withColumn("score", grid(F.col("final") / divisor, 4))


def group_tops(scored: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """``group, _top, _cut``: the largest final, and one that ``k`` rows of the group reach.

    Rows are dealt to ``4 * k`` parts of their group by ``key``. The k-th largest of the parts'
    own largest is reached by a row in each of k parts; few other rows do. It is null if fewer
    parts have a final. Both are combined in every task first.
    """
    part = F.pmod(F.xxhash64(key), F.lit(max(1, 4 * k)))
    best = scored.groupBy(group, part.alias("_part")).agg(F.max("final").alias("_best"))
    kth = F.get(F.sort_array(F.collect_list("_best"), asc=False), F.lit(k - 1))
    return best.groupBy(group).agg(F.max("_best").alias("_top"), kth.alias("_cut"))


def normalised_per_group(scored: DataFrame, group: str, tops: DataFrame) -> DataFrame:
    """``score`` as :func:`normalised`, over the largest final of the row's group.

    ``tops`` are those of :func:`group_tops`. Rows whose score is below that of ``_cut`` are not
    among the k best of their group, whatever their ids, and are left out.
    """
    divisor = F.when(F.col("_top") == 0.0, F.lit(1.0)).otherwise(F.col("_top"))
    cut = F.col("_cut")
    # with a largest final below 0 the order of scores is not that of finals
    return scored.join(tops, group).withColumn("score", grid(F.col("final") / divisor, 4)).where(
        cut.isNull() | (F.col("_top") < 0) | (F.col("score") >= grid(cut / divisor, 4))).drop(
        "_top", "_cut")


_KEYS = ((F.desc, "score"), (F.asc, "candidate_id"), (F.asc, "row_id"))


def _order(df: DataFrame) -> list:
    return [way(name) for way, name in _KEYS if name in df.columns]


def top_ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows with their rank; the window sees k rows only."""
    best = scores.orderBy(*_order(scores)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_order(scores))))


def top_per_group(scores: DataFrame, group: str, k: int) -> DataFrame:
    """The k best rows of every group; each task first drops rows beyond its
    own k best of a group, so a hot group shuffles at most k rows per task."""
    window = Window.partitionBy(group).orderBy(*_order(scores))
    return scores.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def all_ranked(scores: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``row_id, candidate_id, score, rank`` of every row in the global order.

    Only these are sorted and written; what is shown of a row is joined to its rank.
    """
    narrow = scores.select("row_id", "candidate_id", "score")
    return number_rows(narrow, "rank", *_order(narrow), scratch=scratch)
