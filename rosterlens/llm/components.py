"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterlens.llm.common import stored


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on ``(a, b)`` with a > b: neighbours move to the smallest of them.

    large: each node's larger neighbours; small: its smaller ones and itself. The smallest is
    found by a combined aggregate; the join back lets Spark split a hot node.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(
            "a", F.least("a", "least").alias("least"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"),
                                                            F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a").where("b <> least").select(
            F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``(a, b)``: the smallest id that it reaches.

    Alternating large and small star steps; each round is a written table, so nothing is lost
    with an executor. Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                              F.least("a", "b").alias("b")).distinct())
    while True:
        # done when each node has one edge and no target has an edge of its own
        state = now.groupBy("a").agg(F.count("*").alias("n")).agg(
            F.count("*").alias("nodes"), F.sum("n").alias("edges"))
        nodes, count = state.first()
        if not nodes:
            break
        if nodes == count and not now.select("a").join(
                now.select(F.col("b").alias("a")), "a", "left_semi").take(1):
            break
        now = stored(_starred(_starred(now, True), False))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
