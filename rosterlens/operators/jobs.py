"""Role descriptions: a table of free texts to a table of specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterlens import fixed_values as fv
from rosterlens.functions.basics import (
    SPACE, as_word, contains_any, let, string_lists, strings, strip)
from rosterlens.functions.lexicon import (
    domain_vector, label_of, no_hits, text_hits, top_domains, top_positions)
from rosterlens.settings import JobSpec, Lexicon, Settings

_LINE_END = r"\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029"


def title(text: Column, settings: Settings) -> Column:
    """What follows a title label on the first non-blank line, else the line."""
    line = strip(F.regexp_extract(text, rf"(?U)^{SPACE}*([^{_LINE_END}]*)", 1))
    return let(line, lambda first: F.substring(
        F.when(first.rlike(fv.TITLE_LABEL),
               strip(F.regexp_extract(first, fv.TITLE_LABEL, 1))).otherwise(first),
        1, settings.title_length))


def experience_band(text: Column) -> Column:
    """struct(exp_min, exp_max, exp_ideal) from the first rule that matches."""
    def found(t: Column, pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(t, "(?U)" + pattern, group).try_cast("double")

    def band(lo: Column, hi: Column, ideal: Column) -> Column:
        return F.struct(lo.cast("double").alias("exp_min"), hi.cast("double").alias("exp_max"),
                        ideal.cast("double").alias("exp_ideal"))

    def rules(t: Column) -> Column:
        low, high = found(t, fv.YEARS_RANGE, 1), found(t, fv.YEARS_RANGE, 2)
        floor = F.coalesce(found(t, fv.YEARS_FLOOR), found(t, fv.YEARS_PLUS))
        bare = found(t, fv.YEARS_BARE)
        return (F.when(low.isNotNull(), band(low, high, (low + high) / 2.0))
                .when(floor.isNotNull(), band(floor, floor + 6, floor + 1))
                .when(bare.isNotNull(), band(F.greatest(F.lit(0.0), bare - 2), bare + 3, bare))
                .otherwise(band(F.lit(0.0), F.lit(50.0), F.lit(0.0))))
    return let(F.lower(text), rules)


def places(text: Column, gazetteer: tuple[str, ...]) -> Column:
    """Sorted names of the list that occur as whole words."""
    return let(F.lower(text), lambda t: F.array_compact(F.array(*[
        F.when(t.rlike(as_word(g)), F.lit(g)) for g in sorted(set(gazetteer))])))


def exclusions(text: Column, settings: Settings) -> Column:
    """Specialties named in or shortly after an exclusion marker.

    A fold over the clauses: a marker opens a window of clauses, and a later
    marker extends it. The state is one counter and at most one entry per known
    specialty, so it stays small for any length of text.
    """
    def named(clause: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(clause.rlike(as_word(s)), F.lit(s)) for s in settings.specialties]))

    def step(acc: Column, clause: Column) -> Column:
        left = F.when(contains_any(clause, settings.exclusion_markers),
                      settings.exclusion_window).otherwise(acc["left"])
        return let(left, lambda n: F.struct(
            F.greatest(n - 1, F.lit(0)).alias("left"),
            F.when(n > 0, F.array_union(acc["found"], named(clause)))
            .otherwise(acc["found"]).alias("found")))

    start = F.struct(F.lit(0).alias("left"), strings([]).alias("found"))
    return F.aggregate(F.split(F.lower(text), fv.CLAUSE_BREAK, -1), start, step,
                       lambda acc: acc["found"])


def keywords(text: Column, vector: Column, lexicon: Lexicon, settings: Settings) -> Column:
    """Phrases of the three leading domains found in the text, at most ``keyword_cap``."""
    phrases = string_lists(d.terms + d.titles for d in lexicon.domains)
    offered = F.flatten(F.transform(top_positions(vector, 3, 0.12),
                                    lambda p: F.get(phrases, p)))
    return let(F.lower(text), lambda t: F.slice(F.array_distinct(F.filter(
        offered, lambda k: t.contains(k) & (F.length(k) > 2))), 1, settings.keyword_cap))


def job_specs(jobs: DataFrame, lexicon: Lexicon, settings: Settings) -> DataFrame:
    """Add the specification columns to ``(…, text)``. No shuffle."""
    text = F.col("text")
    first = top_domains(F.col("vector"), lexicon, 3, 0.15)
    return (
        jobs
        .withColumn("title", title(text, settings))
        .withColumn("_band", experience_band(text))
        .withColumn("cities", places(text, settings.cities))
        .withColumn("countries", places(text, settings.countries))
        .withColumn("excluded", exclusions(text, settings))
        .withColumn("vector", domain_vector(
            F.lower("title"), no_hits(lexicon), text_hits(F.lower(text), lexicon), lexicon))
        .withColumn("target_domains", let(first, lambda d: F.when(F.size(d) > 0, d).otherwise(
            top_domains(F.col("vector"), lexicon, 1, 0.0))))
        .withColumn("keywords", F.array_except(
            keywords(text, F.col("vector"), lexicon, settings), F.col("excluded")))
        .select("*", "_band.*").drop("_band")
        .withColumn("has_location_pref", (F.size("cities") > 0) | (F.size("countries") > 0)))


def parse_job(spark, text: str, lexicon: Lexicon, settings: Settings) -> JobSpec:
    """Specification of a single role text (one row)."""
    jobs = spark.range(1).select(F.lit(text).alias("text"))
    return JobSpec.from_row(job_specs(jobs, lexicon, settings).first())


def spec_view(specs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """How a description was understood: labels, band, places, first 8 terms."""
    def joined(array: Column, empty: str) -> Column:
        return F.coalesce(F.nullif(F.array_join(array, ", "), F.lit("")), F.lit(empty))

    years = F.concat(F.rint("exp_min").cast("int").cast("string"), F.lit("–"),
                     F.rint("exp_max").cast("int").cast("string"), F.lit(" yrs"))
    where = F.when(F.size("cities") > 0, F.col("cities")).otherwise(F.col("countries"))
    labels = F.transform("target_domains", lambda d: label_of(d, lexicon, d))
    return specs.withColumns({
        "role_domain": joined(labels, "general"),
        "experience": F.when((F.col("exp_min") <= 0) & (F.col("exp_max") >= 50), "any")
        .otherwise(years),
        "places": joined(where, "any"),
        "key_terms": joined(F.slice("keywords", 1, 8), "—")})
