"""From facts to a scored frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.functions import integrity, scores
from rosterlens.functions.basics import lower_text
from rosterlens.functions.lexicon import domain_vector, dot
from rosterlens.functions.roles import Role, columns_of
from rosterlens.settings import Lexicon, Settings

COMPONENTS = ("role_fit", "semantic", "evidence", "experience", "company_type", "location_score")
# component column -> name of its weight
WEIGHT_OF = dict(zip(COMPONENTS, ("role_fit", "semantic", "evidence", "experience",
                                  "company_type", "location")))


def with_domain_vector(facts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Put the domain vector in the place of the term hits: it is the same for every role."""
    return facts.withColumn("domain_vector", domain_vector(
        F.lower(F.coalesce("title", F.lit(""))), F.col("past_hits"), F.col("term_hits"),
        lexicon)).drop("term_hits")


def with_own_gates(facts: DataFrame, settings: Settings) -> DataFrame:
    """Findings and gates that no role changes."""
    c = F.col
    offences = (c("overlong"), c("n_roles"), c("total_months"), c("mastery_zero"),
                c("misdated"), c("yoe"))
    return (
        facts
        .withColumns({"hard": integrity.hard_finding(*offences),
                      "n_reasons": integrity.finding_count(*offences)})
        .withColumns({
            "behavioral": scores.availability(
                c("response_rate"), c("last_active"), c("open_to_work"), c("interview_rate"),
                c("notice_days"), c("completeness"), c("email_ok"), c("phone_ok"), settings),
            "hop": scores.job_hopping(c("n_completed"), c("completed_months")),
            "soft": integrity.soft_penalty(c("n_reasons"))}))


@dataclass(frozen=True)
class Met:
    """What of a row a role meets; a block of roles has it looked up (see ``plans.rank_many``)."""

    cosine: Column
    n_found: Column
    employers: Column
    in_city: Column
    in_country: Column
    excluded: Column

    @classmethod
    def of(cls, spec: Role, settings: Settings) -> "Met":
        r, c = columns_of(spec), F.col
        return cls(
            dot(c("domain_vector"), r.vector), F.size("found"),
            scores.employers(c("n_roles"), c("n_consulting"), c("n_product"), c("n_nontech"),
                             c("industry"), settings),
            scores.holds_any(lower_text(c("location")), r.cities),
            scores.holds_any(lower_text(c("country")), scores.countries_of(r, settings)),
            scores.holds_any(lower_text(c("title")), r.excluded))


def local_parts(facts: DataFrame, spec: Role, lexicon: Lexicon, settings: Settings,
                met: Met | None = None) -> DataFrame:
    """Every component and gate that needs the row alone. No shuffle, no UDF.

    ``term_hits`` and ``found`` stand for the text (see ``text_features``). With ``met`` the row
    may be without them and the other columns that ``met`` is taken from.
    """
    c = F.col
    shown = {"evidence_terms": F.slice("found", 1, 6)} if "found" in facts.columns else {}
    met = met or Met.of(spec, settings)
    if "term_hits" in facts.columns:
        facts = with_domain_vector(facts, lexicon)
    if "behavioral" not in facts.columns:
        facts = with_own_gates(facts, settings)
    return (
        facts
        .withColumns({
            "role_fit": scores.role_fit(met.cosine),
            "avg_assessment": scores.assessment_mean(
                c("rel_n"), c("rel_sum"), c("all_n"), c("all_sum"))})
        .withColumn("evidence", scores.evidence_share(met.n_found, spec))
        .withColumns(shown | {
            "experience": scores.experience(c("yoe"), spec),
            "company_type": scores.if_technical(met.employers, spec, lexicon),
            "location_score": scores.located(met.in_city, met.in_country, c("relocate"), spec),
            "verified": scores.corroboration(c("avg_assessment"), c("github"), spec, lexicon),
            "stuffer": scores.stuffing(c("skill_hits"), c("role_fit")),
            "negative": scores.excluded_if(met.excluded, c("evidence")),
            "github_shown": F.when(c("github") >= 0, c("github")),
            "n_assessments": F.when(c("rel_n") > 0, c("rel_n")).otherwise(c("all_n"))})
        .drop("found"))


def with_reasons(parts: DataFrame) -> DataFrame:
    """Add the findings as texts; for the rows that are shown, not for the pool."""
    return parts.withColumn("reasons", integrity.reasons(*[F.col(n) for n in (
        "overlong", "n_roles", "total_months", "mastery_zero", "misdated", "yoe")]))


def combined(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted base and the product with the gates."""
    base = scores.weighted_base({WEIGHT_OF[n]: F.col(n) for n in COMPONENTS}, weights)
    return parts.withColumn("base", base).withColumn("final", scores.gated(
        *[F.col(n) for n in ("base", "behavioral", "verified", "stuffer", "negative",
                             "hop", "soft", "hard")]))


def semantic(parts: DataFrame, tfidf: DataFrame | None, dense: DataFrame | None,
             key: str) -> DataFrame:
    """Attach the scaled TF-IDF similarity and, where present, the dense one, unless they are there."""
    df = parts if tfidf is None else parts.join(tfidf, key, "left").withColumn(
        "tfidf", F.coalesce("tfidf", F.lit(0.0)))
    if dense is not None:
        df = df.join(dense, "candidate_id", "left")
    if "dense" not in df.columns:
        return df.withColumn("semantic", F.col("tfidf"))
    return df.withColumn("semantic", scores.blended(F.col("tfidf"), F.col("dense"))).drop("dense")


