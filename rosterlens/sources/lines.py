"""Lines of text files with their place, without sorting or gathering them.

A scan hands out splits of files. Each is counted by itself, the counts of the splits before it
give the number of its first line, and a line adds its place in its split. What moves between
tasks is one row a split.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rosterlens.sources.scratch import materialise

_GLOB = set("*?[]{}\\")


def split_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value`` with the file and the start of the split that it was read from."""
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_begin"))


def split_offsets(placed: DataFrame) -> DataFrame:
    """``_file, _begin, _first, _n, _before`` of the splits of lines with ``_at``."""
    before = Window.orderBy("_file", "_begin").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("_file", "_begin").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def with_number(lines: DataFrame, name: str) -> DataFrame:
    """Add a 1-based position in the order of files and of lines in them.

    ``lines`` are rows of :func:`split_lines`, some of which may have been filtered out. The
    counts are a small written table, whose size tells Spark how to join it; a split that they do
    not know, because files changed in between, is an error.
    """
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    offsets = materialise(split_offsets(placed))
    return placed.join(offsets, ["_file", "_begin"], "left").withColumn(
        name, F.coalesce(F.col("_before") + F.col("_at") - F.col("_first") + 1, F.raise_error(
            F.lit("files changed while they were read")).cast("bigint"))).drop(
        "_at", "_first", "_n", "_before")


def first_lines(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """``value`` of the first ``limit`` lines, blank ones included, in the order of the files.

    Only as many files are counted as hold these lines: four times as many in each try.
    """
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    if any(_GLOB & set(f) for f in files):
        return _up_to(split_lines(spark, path), limit)
    take = 1
    while take < len(files) and split_lines(spark, files[:take]).count() < limit:
        take *= 4
    return _up_to(split_lines(spark, files[:take]), limit) if files else \
        spark.createDataFrame([], "value string")


def _up_to(lines: DataFrame, limit: int) -> DataFrame:
    return with_number(lines, "_line").where(F.col("_line") <= limit).select("value")
