"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Time runs in slots of one block. The j-th block of a source of weight w may start at
floor((j-1)/w) and must be placed by ceil(j/w); in each slot the released block of the earliest
deadline goes first. Weights are whole shares of a cycle of slots, so the order of one cycle
serves for all: block j of a source of share p is in cycle (j-1) div p. Until the first source
has run out, the blocks placed from a source differ by less than one from its weight times the
slots; then its slots stay empty and the others keep their proportions. No row is dropped.

A cycle has ``CYCLE`` slots, or ten for each source where that is more: there may be any number
of sources. Those of one share have equal release times and deadlines and take turns, so a slot
is decided among the distinct shares, of which a cycle has few. The plan of a cycle is one row.

Rows of a source are put into blocks by a hash of the id. A null source is a source of its own.
Rows with equal ids and texts may take each other's place; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlens.functions.basics import let
from rosterlens.llm.common import operator, stored

BLOCK = 16       # documents of a block
CYCLE = 1000     # slots over which the weights are met exactly, at least
PER_SOURCE = 10  # slots of a cycle for each source, at least


def shares(weights: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """``source, share``: weights as whole slots of a cycle, each at least one.

    Largest remainders take what rounding leaves. One row a source, at most ``cycle`` of them.
    """
    everywhere = Window.partitionBy(F.lit(0))
    weight = F.col("weight") / F.sum("weight").over(everywhere)
    spare = F.lit(cycle) - F.count("*").over(everywhere)   # one slot each is given beforehand
    exact = weights.select("source", (weight * spare).alias("exact"), spare.alias("spare"))
    floor = exact.withColumn("whole", F.floor("exact"))
    rank = F.row_number().over(everywhere.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"),
                                                                 9)), "source"))
    left = F.col("spare") - F.sum("whole").over(everywhere)
    return floor.select("source", (1 + F.col("whole") + (rank <= left).cast("long"))
                        .alias("share"))


def _edf(groups: Column, cycle: int) -> Column:
    """Order of one cycle: in each slot, which group of ``(share, n)`` places its next block.

    The n sources of a group place their j-th blocks one after the other.
    """
    def step(state: Column, t: Column) -> Column:
        def deadline(group: Column, i: Column) -> Column:
            # next block of the group's next source: number done + 1, released at
            # floor(done * cycle / share)
            share = group["share"]
            done = F.floor(F.get(state["placed"], i) / group["n"])
            due = -F.floor(-(done + 1) * cycle / share)
            ready = (done < share) & (F.floor(done * cycle / share) <= t)
            return F.when(ready, F.struct(due.alias("due"), share.alias("share"), i.alias("i")))

        first = F.array_min(F.filter(F.transform(groups, deadline), lambda x: x.isNotNull()))["i"]
        return let(first, lambda pick: F.struct(
            F.transform(state["placed"], lambda n, i: n + F.when(i == pick, 1).otherwise(0))
            .alias("placed"),
            F.concat(state["order"], F.array(pick)).alias("order")))

    start = F.struct(F.transform(groups, lambda x: F.lit(0).cast("long")).alias("placed"),
                     F.array().cast("array<int>").alias("order"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(cycle - 1)), start, step)["order"]


def cycle_order(shared: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """``source, share, turn, at``: slot ``at`` of the cycle has block ``turn`` of the source."""
    group = Window.partitionBy("share").orderBy(F.col("source").isNull(), "source")
    members = shared.withColumn("member", F.row_number().over(group) - 1)
    groups = shared.groupBy("share").agg(F.count("*").alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("share", "n"))).alias("groups")).where(
        F.size("groups") > 0)   # distinct shares of one cycle
    laid = groups.select("groups", F.posexplode(_edf(F.col("groups"), cycle)).alias("at", "i"))
    own = F.get("groups", F.col("i"))
    placed = laid.select("at", own["share"].alias("share"), own["n"].alias("n"))
    number = F.row_number().over(Window.partitionBy("share").orderBy("at")) - 1
    turns = placed.withColumn("number", number).select(
        "share", F.col("at").cast("long").alias("at"),
        F.floor(F.col("number") / F.col("n")).alias("turn"),
        (F.col("number") % F.col("n")).alias("member"))
    return members.join(turns, ["share", "member"]).select("source", "share", "turn", "at")


def blocks(docs: DataFrame, block: int = BLOCK, *columns: str) -> DataFrame:
    """Rows of ``columns`` with ``source``, ``block_no`` (from 0 in each source) and ``place``.

    Ranks are counted in shares of a source and shifted by the counts of the earlier shares, so
    a source with a third of all rows is spread over all tasks.
    """
    most = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = next(k for k in range(1, 33) if 16 ** k >= most)
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    part = F.substring(shuffled, 1, digits)
    sizes = docs.groupBy("source", part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(F.col("source").alias("_s"), "part",
                         F.coalesce(before, F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy(shuffled, "doc_id"))
    dealt = docs.select("source", "doc_id", *columns, part.alias("part")).withColumn("own", own)
    rank = F.col("shift") + F.col("own") - 1
    return dealt.join(shift, F.col("source").eqNullSafe(F.col("_s"))
                      & (dealt["part"] == shift["part"])).select(
        "source", "doc_id", *columns, F.floor(rank / block).alias("block_no"),
        (rank % block).alias("place"))


def square_root_weights(docs: DataFrame) -> DataFrame:
    """Target weights that lie between equal ones and those of the corpus: roots of the counts."""
    return docs.groupBy("source").agg(F.sqrt(F.count("*")).alias("weight"))


@operator
def mixed_order(docs: DataFrame, weights: DataFrame, *columns: str, block: int = BLOCK,
                cycle: int | None = None) -> DataFrame:
    """``doc_id, source, slot, place`` and ``columns``: slot by slot, place by place, the mix.

    ``weights`` has a positive ``weight`` for each source of ``docs``. ``cycle`` must have a slot
    for each source. Give narrow ``columns``: they go through the ranking of a source's rows.
    """
    sources = weights.count()
    if cycle is None:
        cycle = max(CYCLE, PER_SOURCE * sources)
    elif cycle < sources:
        raise ValueError(f"{sources} sources do not fit a cycle of {cycle} slots")
    # small written tables, one row a slot and one a source: their sizes tell Spark how to join
    laid = stored(cycle_order(shares(weights, cycle), cycle).withColumnRenamed("source", "_source"))
    sizes = stored(laid.select("_source", "share").distinct())
    counted = blocks(docs, block, *columns).join(
        sizes, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = counted.withColumn("turn", F.col("block_no") % F.col("share"))
    return placed.join(
        laid.drop("share"),
        F.col("source").eqNullSafe(F.col("_source")) & (placed["turn"] == laid["turn"])).select(
        "doc_id", "source", (F.floor(F.col("block_no") / F.col("share")) * cycle + F.col("at"))
        .alias("slot"), F.col("place").cast("int").alias("place"), *columns)
