"""Views of ranked rows: audit, flags, filters, contributions, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.functions.basics import exact_round
from rosterlens.functions.lexicon import top_domains
from rosterlens.functions.phrases import domain_text, explanation
from rosterlens.operators.scoring import COMPONENTS, WEIGHT_OF
from rosterlens.settings import JobSpec, Lexicon, Settings

ROUNDED = (*COMPONENTS, "behavioral", "verified", "stuffer", "negative")
_FACTS = ("title", "yoe", "location", "country", "relocate", "response_rate", "notice_days")
_PARTS = ("role_fit", "evidence_terms", "avg_assessment", "company_type", "stuffer",
          "behavioral", "n_reasons")


def explained(ranked: DataFrame, spec: JobSpec, lexicon: Lexicon,
              settings: Settings) -> DataFrame:
    """Add ``reasoning`` to rows that already carry ``rank``."""
    return ranked.withColumn("reasoning", explanation(
        F.col("rank"), {n: F.col(n) for n in _FACTS}, {n: F.col(n) for n in _PARTS},
        spec, lexicon, settings))


def audit(explained_rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The 22 audit columns, components rounded to three decimals."""
    domain = domain_text(top_domains(F.col("domain_vector"), lexicon, 2, 0.2), lexicon)
    return explained_rows.select(
        "rank", "candidate_id", "score", "title", "yoe", "location", "country", "company",
        "industry", domain.alias("domain"),
        *[exact_round(F.col(n), 3).alias(n) for n in ROUNDED],
        F.col("hard").alias("honeypot"), "reasoning")


def flag_text() -> Column:
    """First matching flag of an audit row."""
    return (F.when(F.col("honeypot"), "honeypot")
            .when(F.col("stuffer") < 0.9, "stuffer")
            .when(F.col("negative") < 1.0, "excluded specialty")
            .otherwise("clean"))


def filtered(audit_rows: DataFrame, top_n: int, country: str | None = None,
             min_yoe: float = 0, hide_flagged: bool = True) -> DataFrame:
    """Filters on the finished ranking; ranks are kept, not renumbered."""
    df = audit_rows
    if country is not None:
        df = df.where(F.col("country") == country)
    if min_yoe > 0:
        df = df.where(F.col("yoe") >= min_yoe)
    if hide_flagged:
        df = df.where(~F.col("honeypot") & (F.col("stuffer") >= 0.9))
    return df.orderBy("rank").limit(top_n)


def contributions(audit_rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Six rows per candidate: component value times weight."""
    weighted = [F.col(n) * F.lit(weights[WEIGHT_OF[n]]) for n in COMPONENTS]
    wide = audit_rows.select("candidate_id", "rank",
                             *[w.alias(n) for w, n in zip(weighted, COMPONENTS)])
    return wide.unpivot(["candidate_id", "rank"], list(COMPONENTS), "component", "value")


def candidate_detail(candidates: DataFrame, candidate_id: str) -> DataFrame:
    """First six roles of one candidate, descriptions cut to 280 characters."""
    history = F.slice("career_history", 1, 6)
    return (candidates.where(F.col("candidate_id") == candidate_id)
            .select("candidate_id", "profile", "signals", F.posexplode_outer(history)
                    .alias("role_no", "role"))
            .select("candidate_id", "profile", "signals", "role_no",
                    F.col("role").withField("description", F.substring(
                        F.coalesce("role.description", F.lit("")), 1, 280)).alias("role")))
