"""Global positions and exact percentiles without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlens.sources.scratch import Scratch, materialise

_INDEX_BITS = 33  # monotonically_increasing_id: task number above, row below


def _sorted_slices(df: DataFrame, *order: Column, scratch: Scratch | None = None) -> DataFrame:
    """Range-sort, remember each row's slice and place, and keep the result.

    The sample that picks the range bounds may differ between two runs of the
    same plan; the written copy pins slice numbers down.
    """
    ordered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    keep = materialise if scratch is None else scratch.keep
    return (keep(ordered)
            .withColumn("_slice", F.shiftright("_at", _INDEX_BITS))
            .withColumn("_place", F.col("_at").bitwiseAND(F.lit(2 ** _INDEX_BITS - 1)))
            .drop("_at"))


def _offsets(slices: DataFrame, size: Column) -> DataFrame:
    """Rows before each slice. One row per shuffle partition, never per record."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (slices.groupBy("_slice").agg(size.alias("_size"))
            .select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")))


def number_rows(df: DataFrame, name: str, *order: Column,
                scratch: Scratch | None = None) -> DataFrame:
    """Add a dense 1-based position in the global order of ``order``.

    One range shuffle; hot sort values are split as long as ``order`` ends in a
    distinguishing column.
    """
    slices = _sorted_slices(df, *order, scratch=scratch)
    offsets = _offsets(slices, F.count(F.lit(1)))
    return (slices.join(F.broadcast(offsets), "_slice")
            .withColumn(name, F.col("_before") + F.col("_place") + 1)
            .drop("_slice", "_place", "_before"))


def exact_percentile(df: DataFrame, column: str, percent: Column | float,
                     scratch: Scratch | None = None) -> DataFrame:
    """One row ``(n, value)``: the linearly interpolated percentile of a column.

    Equal values are merged before the sort, so a value shared by a third of
    the rows costs one record; only the slices holding the two neighbouring
    ranks are numbered. ``percent`` may depend on the count ``n``.
    """
    share = percent if isinstance(percent, Column) else F.lit(float(percent))
    values = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    slices = _sorted_slices(values, F.col("_v"), scratch=scratch)
    total = slices.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    rank = (F.col("n") - 1) * (share / 100.0)
    target = total.select("n", F.floor(rank).alias("_lo"), F.ceil(rank).alias("_hi"),
                          (rank - F.floor(rank)).alias("_t"))
    ends = slices.groupBy("_slice").agg(F.sum("_n").alias("_rows"))
    starts = _offsets(slices, F.sum("_n"))
    # at most two slices survive: those that contain rank _lo and rank _hi
    wanted = (ends.join(F.broadcast(starts), "_slice")
              .join(F.broadcast(target),
                    (F.col("_before") <= F.col("_hi"))
                    & (F.col("_before") + F.col("_rows") > F.col("_lo"))))
    running = Window.partitionBy("_slice").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = (slices.join(F.broadcast(wanted), "_slice")
            .withColumn("_upto", F.col("_before") + F.sum("_n").over(running)))
    picked = near.agg(
        F.min(F.when(F.col("_upto") > F.col("_lo"), F.col("_v"))).alias("a"),
        F.min(F.when(F.col("_upto") > F.col("_hi"), F.col("_v"))).alias("b"),
        F.max("_t").alias("t"), F.max("n").alias("n"))
    step = F.col("b") - F.col("a")
    value = F.when(F.col("t") >= 0.5, F.col("b") - step * (1.0 - F.col("t"))).otherwise(
        F.col("a") + step * F.col("t"))
    return picked.select(F.coalesce("n", F.lit(0)).alias("n"), value.alias("value"))


RANGES = 4096   # of values; those of 0 to 1 have a quarter


def _not_below(df: DataFrame, group: str, column: str, rows: Column, percent: Column) -> DataFrame:
    """Rows of ``df`` but those in ranges of values below the one that holds the percentile."""
    value = F.col(column)
    wide = F.least(F.lit(RANGES - 1.0), value * (RANGES / 4))   # NaN counts as the largest
    df = df.withColumn("_range", F.when(F.isnan(value), RANGES).otherwise(F.floor(wide)).cast("int"))
    above = Window.partitionBy(group).orderBy(F.desc("_range"))   # the ranges of a group
    first = rows - F.sum("_n").over(above)   # rank of the range's least value
    cuts = (df.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_first", first)
            .where(F.col("_first") <= F.floor((rows - 1) * (percent / 100.0)))
            .groupBy(group).agg(F.max("_range").alias("_least")))
    return df.join(F.broadcast(cuts), group, "left").where(
        F.col("_least").isNull() | (F.col("_range") >= F.col("_least"))).drop("_range", "_least")


def grouped_percentiles(df: DataFrame, group: str, column: str, rows: Column, percent: Column,
                        scratch: Scratch | None = None) -> DataFrame:
    """``(group, value)``: the linearly interpolated percentile of each group's positive values.

    Each group has ``rows`` values, of which ``df`` holds those above 0. Counts of ranges of values
    tell which of them lie below the percentile for certain; the other groups and values are
    sorted together and positions are counted by slices, so no group is put into one task.
    """
    df = _not_below(df, group, column, rows, percent)
    values = df.groupBy(group, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    slices = _sorted_slices(values, F.col(group), F.col("_v"), scratch=scratch)
    running = Window.partitionBy("_slice").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = slices.withColumn("_run", F.sum("_n").over(running)).join(
        F.broadcast(_offsets(slices, F.sum("_n"))), "_slice").select(
        group, "_v", (F.col("_before") + F.col("_run")).alias("_upto"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)   # one row a group
    sizes = slices.groupBy(group).agg(F.sum("_n").alias("_held")).select(
        group, (rows - F.col("_held")).alias("_zeros"),
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    rank = (rows - 1) * (percent / 100.0)
    # position of a rank among the positive values of all groups; below 0 in its own: a zero
    low, high = (F.col("_start") + f(rank) - F.col("_zeros") for f in (F.floor, F.ceil))

    def at(position: Column) -> Column:
        found = F.min(F.when(F.col("_upto") > position, F.col("_v")))
        return F.when(F.max(position) < F.max("_start"), 0.0).otherwise(found)

    step = F.col("b") - F.col("a")
    t = rank - F.floor(rank)
    value = F.when(t >= 0.5, F.col("b") - step * (1.0 - t)).otherwise(F.col("a") + step * t)
    return upto.join(F.broadcast(sizes), group).groupBy(group).agg(
        at(low).alias("a"), at(high).alias("b")).select(group, value.alias("value"))
