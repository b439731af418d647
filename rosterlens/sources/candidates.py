"""Candidate files: tolerant and strict JSON lines, JSON arrays, guards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rosterlens.sources.lines import first_lines

_ROLE = ("title STRING, description STRING, industry STRING, company STRING, "
         "is_current BOOLEAN, duration_months DOUBLE, start_date STRING, end_date STRING")
_SIGNALS = ("willing_to_relocate BOOLEAN, open_to_work_flag BOOLEAN, verified_email BOOLEAN, "
            "verified_phone BOOLEAN, recruiter_response_rate DOUBLE, "
            "interview_completion_rate DOUBLE, last_active_date STRING, "
            "notice_period_days DOUBLE, profile_completeness_score DOUBLE, "
            "github_activity_score DOUBLE, skill_assessment_scores MAP<STRING, VARIANT>")
CORRUPT = "_corrupt"


def candidate_schema(signals_field: str = "signals") -> T.StructType:
    """Schema of one record; ``signals_field`` names the platform-signals object."""
    return T.StructType.fromDDL(
        "candidate_id STRING, "
        "profile STRUCT<headline STRING, summary STRING, current_title STRING, "
        "current_industry STRING, current_company STRING, years_of_experience DOUBLE, "
        "location STRING, country STRING>, "
        f"career_history ARRAY<STRUCT<{_ROLE}>>, "
        "skills ARRAY<STRUCT<name STRING, proficiency STRING, duration_months DOUBLE>>, "
        "education ARRAY<STRUCT<field_of_study STRING>>, "
        f"`{signals_field}` STRUCT<{_SIGNALS}>")


_JSON = {"allowSingleQuotes": "false"}
_NUMBERS = {"profile": ("years_of_experience",), "career_history": ("duration_months",),
            "skills": ("duration_months",)}
_SIGNAL_NUMBERS = ("recruiter_response_rate", "interview_completion_rate", "notice_period_days",
                   "profile_completeness_score", "github_activity_score")


def _text_schema(signals_field: str) -> T.StructType:
    """The record schema with numbers as text: a number may be written as a string."""
    return T.StructType.fromJson(json.loads(
        candidate_schema(signals_field).json().replace('"double"', '"string"')))


def _number(value: Column) -> Column:
    return F.when(value.rlike(r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"), value.try_cast("double"))


def _typed(df: DataFrame, signals_field: str) -> DataFrame:
    """Numbers read as text, cast: ``"7"`` is 7, other text is null."""
    def cast(item: Column, names: tuple[str, ...]) -> Column:
        for name in names:
            item = item.withField(name, _number(item[name]))
        return item

    def each(column: str) -> Column:
        return F.transform(column, lambda x: cast(x, _NUMBERS[column]))

    return df.withColumns({
        "profile": cast(F.col("profile"), _NUMBERS["profile"]),
        "career_history": each("career_history"), "skills": each("skills"),
        signals_field: cast(F.col(signals_field), _SIGNAL_NUMBERS)})


def _one_value(value: Column) -> Column:
    """Whether a line holds one JSON value and nothing after it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1,
                      F.lit(False))


def _numeric_scores(df: DataFrame, signals_field: str) -> DataFrame:
    """Cast numbers, rename the signals object, keep only numeric assessment scores.

    JSON numbers and booleans count as numbers; strings, objects and nulls do
    not, whatever they look like.
    """
    df = _typed(df, signals_field)
    scores = F.col(signals_field)["skill_assessment_scores"]
    kinds = F.transform_values(scores, lambda _, v: F.struct(
        F.schema_of_variant(v).alias("kind"),
        F.try_variant_get(v, "$", "double").alias("value"),
        F.try_variant_get(v, "$", "boolean").alias("truth")))
    numeric = F.map_filter(kinds, lambda _, v: v["kind"].rlike(
        "^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"))
    values = F.transform_values(numeric, lambda _, v: F.when(
        v["kind"] == "BOOLEAN", v["truth"].cast("int").cast("double")).otherwise(v["value"]))
    out = df.withColumn(signals_field, F.col(signals_field).withField(
        "skill_assessment_scores", values))
    return out if signals_field == "signals" else out.withColumnRenamed(signals_field, "signals")


def read_jsonl(spark: SparkSession, path: str, signals_field: str = "signals",
               limit: int | None = None) -> DataFrame:
    """JSON lines; blank and malformed lines leave the result silently.

    ``limit`` counts raw lines before anything is skipped.
    """
    return _numeric_scores(
        _parsed(spark, path, signals_field, limit).where(~_rejected()), signals_field
    ).drop(CORRUPT, "value")


def rejected_lines(spark: SparkSession, path: str, signals_field: str = "signals") -> DataFrame:
    """The malformed lines that :func:`read_jsonl` leaves out."""
    return _parsed(spark, path, signals_field, None).where(_rejected()).select("value")


def _lines(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    return spark.read.text(path) if limit is None else first_lines(spark, path, limit)


def _parsed(spark: SparkSession, path: str, signals_field: str, limit: int | None) -> DataFrame:
    lines = _lines(spark, path, limit)
    schema = _text_schema(signals_field).add(CORRUPT, "string")
    record = F.from_json("value", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **_JSON})
    # a generator, not a projection: later filters on the fields would be pushed
    # into a projection and parse the line again for every field they look at
    return lines.where(F.trim("value") != "").select("value", F.inline(F.array(record)))


def _rejected():
    """Malformed JSON: nothing could be read, or more than one value. An odd field is not enough."""
    fields = ("candidate_id", "profile", "career_history", "skills", "education")
    nothing = F.lit(True)
    for f in fields:
        nothing = nothing & F.col(f).isNull()
    return ~_one_value(F.col("value")) | (F.col(CORRUPT).isNotNull() & nothing)


def read_jsonl_strict(spark: SparkSession, path: str, signals_field: str = "signals",
                      limit: int | None = None) -> DataFrame:
    """JSON lines; a malformed line fails the job, blank lines are skipped."""
    lines = _lines(spark, path, limit).where(F.trim("value") != "")
    whole = F.when(_one_value(F.col("value")), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 80))))
    record = F.from_json(whole, _text_schema(signals_field), {"mode": "FAILFAST", **_JSON})
    return _numeric_scores(lines.select(F.inline(F.array(record))), signals_field)


def read_json_array(spark: SparkSession, path: str, signals_field: str = "signals") -> DataFrame:
    """Files that each hold one JSON array; a missing path gives an empty frame."""
    schema = _text_schema(signals_field)
    if not _exists(spark, path):
        return _numeric_scores(spark.createDataFrame([], schema), signals_field)
    return _numeric_scores(
        spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
        .options(**_JSON).json(path),
        signals_field)


def read_upload(spark: SparkSession, path: str, signals_field: str = "signals") -> DataFrame:
    """JSON array or JSON lines, told apart by the first character."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is not None and first["value"].lstrip().startswith("["):
        return read_json_array(spark, path, signals_field)
    return read_jsonl_strict(spark, path, signals_field)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def with_id(candidates: DataFrame) -> DataFrame:
    """Rows with a non-empty id. Ids are not de-duplicated."""
    return candidates.where(F.col("candidate_id") != "")


def require_rows(candidates: DataFrame, top: int) -> DataFrame:
    """Fail when fewer than ``top`` rows exist; stops counting at ``top``."""
    found = candidates.limit(top).count()
    if found < top:
        raise ValueError(f"only {found} candidates, need >= {top}")
    return candidates
