"""Rules a ranked output must keep, each as a small query of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlens import fixed_values as fv
from rosterlens.operators.ordering import number_rows
from rosterlens.sources.lines import split_lines, with_number
from rosterlens.sources.scratch import materialise

_FIRST_ROW = 2  # row 1 is the header
# every cell follows a comma, one of which is put before the line: an empty first cell counts too
_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)("?)([^,]*+)'
_CELL = rf',((?:{_QUOTED})|[^,]*+)'
_FLOAT = (r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity)$")


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; quoted cells may hold commas and doubled quotes.

    A quote that is not closed holds the rest of the line; text after a closing quote belongs to
    the cell as it stands.
    """
    def plain(cell: Column) -> Column:
        body = F.replace(F.regexp_extract(cell, _QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"'), F.concat(
            body, F.regexp_extract(cell, _QUOTED, 3))).otherwise(cell)

    return F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1)), plain)


def read_rows(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header cells and the data rows ``(row, cells)`` of one CSV file.

    Blank rows are dropped before rows are numbered, split by split and without a sort. Cells may
    not hold line breaks, which the ranked output never has.
    """
    lines = split_lines(spark, path).withColumn("_line", F.monotonically_increasing_id())
    head = lines.groupBy("_file", "_begin").agg(
        F.min_by(F.struct("_line", "value"), "_line").alias("first")).orderBy(
        "_file", "_begin").first()
    if head is None:
        return [], spark.createDataFrame([], "row bigint, cells array<string>")
    header = spark.range(1).select(csv_cells(F.lit(head["first"]["value"])).alias("c")).first()["c"]
    is_header = (F.col("_file") == head["_file"]) & (F.col("_begin") == head["_begin"]) \
        & (F.col("_line") == head["first"]["_line"])
    filled = lines.where(~is_header).withColumn("cells", csv_cells(F.col("value"))).where(
        F.exists("cells", lambda c: F.trim(c) != "")).select("_file", "_begin", "cells")
    return list(header), with_number(filled, "_row").select(
        (F.col("_row") + _FIRST_ROW - 1).alias("row"), "cells")


def as_rows(ranked: DataFrame) -> DataFrame:
    """Output columns as ``(row, cells)``; ``rank`` gives the row order."""
    return ranked.select(
        (F.col("rank") + _FIRST_ROW - 1).cast("bigint").alias("row"),
        F.array(*[F.col(c).cast("string") for c in fv.RANKED_COLUMNS]).alias("cells"))


def _issue(df: DataFrame, rule: str, message: Column, row: Column | None = None) -> DataFrame:
    at = F.lit(None) if row is None else row
    return df.select(F.lit(rule).alias("rule"), at.cast("bigint").alias("row"),
                     message.cast("string").alias("message"))


def _repeats(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value already occurred in an earlier row.

    The first row per value is combined in every task before the shuffle; only
    values that repeat are joined back.
    """
    again = df.groupBy(value).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1")
    return df.join(again, value).where(F.col("row") > F.col("_first"))


def violations(rows: DataFrame, header: list[str] | None = None,
               required_rows: int = fv.REQUIRED_ROWS) -> DataFrame:
    """``(rule, row, message)`` of every broken rule; empty when valid."""
    names, last = list(fv.RANKED_COLUMNS), required_rows
    rows = materialise(rows)
    whole = rows.where(F.size("cells") == len(names))
    fields = whole.select("row", *[
        F.trim(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)])
    number = F.col("rank").try_cast("bigint")
    fields = fields.withColumns({
        "n": F.when(number.cast("string") == F.col("rank"), number),
        "s": F.when(F.col("score").rlike(_FLOAT), F.col("score").try_cast("double")),
        "good_id": F.col("candidate_id").rlike(fv.ID_PATTERN)})
    in_range = F.col("n").between(1, last)
    at = F.concat(F.lit("Row "), F.col("row"), F.lit(": "))

    out = [
        _issue(rows.agg(F.count(F.lit(1)).alias("c")).where(F.col("c") != required_rows),
               "row_count", F.concat(F.lit(f"expected {required_rows} data rows, found "), "c")),
        _issue(rows.where(F.size("cells") != len(names)), "cell_count", F.concat(
            at, F.lit(f"expected {len(names)} columns, got "), F.size("cells")), F.col("row")),
        _issue(fields.where("candidate_id = ''"), "id_required",
               F.concat(at, F.lit("candidate_id is required")), F.col("row")),
        _issue(fields.where("candidate_id <> '' and not good_id"), "id_format",
               F.concat(at, F.lit("candidate_id has the wrong form")), F.col("row")),
        _issue(_repeats(fields.where("good_id"), "candidate_id"), "id_duplicate",
               F.concat(at, F.lit("duplicate candidate_id "), "candidate_id"), F.col("row")),
        _issue(fields.where("n is null"), "rank_integer",
               F.concat(at, F.lit("rank must be an integer")), F.col("row")),
        _issue(fields.where(~in_range), "rank_range",
               F.concat(at, F.lit(f"rank must be between 1 and {last}")), F.col("row")),
        _issue(_repeats(fields.where(in_range), "n"), "rank_duplicate",
               F.concat(at, F.lit("duplicate rank "), "n"), F.col("row")),
        _issue(fields.where("s is null"), "score_float",
               F.concat(at, F.lit("score must be a float")), F.col("row")),
    ]
    spark = rows.sparkSession
    wanted = spark.range(1, last + 1).withColumnRenamed("id", "n")
    out.append(_issue(wanted.join(fields.where(in_range).select("n"), "n", "left_anti"),
                      "rank_missing", F.concat(F.lit("missing rank "), "n")))
    if header is not None and list(header) != names:
        out.append(_issue(spark.range(1), "header",
                          F.lit(f"header must be exactly {','.join(names)}"), F.lit(1)))

    usable = fields.where("n is not null and s is not null and candidate_id <> ''")
    placed = number_rows(usable.select("row", "n", "s", "candidate_id"), "pos",
                         F.asc("n"), F.asc("row"))
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("s").alias("s2"),
                          F.col("n").alias("n2"), F.col("candidate_id").alias("id2"))
    # NaN is neither above nor equal to anything
    pairs = placed.join(after, "pos").where(~F.isnan("s") & ~F.isnan("s2"))
    out.append(_issue(pairs.where("s < s2"), "score_order", F.concat(
        F.lit("score must not increase by rank: rank "), "n", F.lit(" < rank "), "n2"),
        F.col("row")))
    out.append(_issue(pairs.where("s = s2 and candidate_id > id2"), "tie_break", F.concat(
        F.lit("equal scores at ranks "), "n", F.lit(" and "), "n2",
        F.lit(" need ascending candidate_id")), F.col("row")))
    return reduce(DataFrame.unionByName, out)
