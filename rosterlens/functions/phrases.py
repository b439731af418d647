"""Sentences that explain a ranked row; applied after the limit only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlens.functions.basics import (
    collapse_spaces, flag, lower_text, no_decimals, number_text, one_decimal)
from rosterlens.functions.lexicon import label_of
from rosterlens.settings import JobSpec, Lexicon, Settings


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def role_phrase(title: Column, yoe: Column) -> Column:
    tenure = F.when(yoe.isNull(), "unknown tenure").otherwise(
        F.concat(one_decimal(yoe), F.lit(" yrs")))
    return F.concat(F.coalesce(_filled(title), F.lit("professional")), F.lit(" with "), tenure)


def location_phrase(place: Column, country: Column, relocate: Column,
                    settings: Settings) -> Column:
    home = settings.home_country
    where = F.coalesce(_filled(place), _filled(country), F.lit("location unknown"))
    tail = F.when(flag(relocate), ", open to relocate)").otherwise(")")
    return F.when(lower_text(country).contains(home.lower()), where).otherwise(
        F.concat(where, F.lit(f" (outside {home}"), tail))


def explanation(rank: Column, facts: dict[str, Column], parts: dict[str, Column],
                spec: JobSpec, lexicon: Lexicon, settings: Settings) -> Column:
    """One or two sentences built from the row's own values."""
    fit = parts["role_fit"]
    aim = (spec.target_domains or ("the",))[0]
    label = lexicon.labels.get(aim, "the target")
    strength = F.when(fit >= 0.6, "strong").when(fit >= 0.35, "partial/adjacent") \
        .otherwise("limited")
    match = F.concat(strength, F.lit(f" match to the {label} role"))
    role = role_phrase(facts["title"], facts["yoe"])
    place = location_phrase(facts["location"], facts["country"], facts["relocate"], settings)

    mentions = F.array_join(F.slice(parts["evidence_terms"], 1, 3), ", ")
    extras = F.array_compact(F.array(
        F.when(mentions != "", F.concat(F.lit("profile mentions "), mentions)),
        F.when(parts["avg_assessment"] >= 75, F.concat(
            F.lit("verified assessment avg "), no_decimals(parts["avg_assessment"]),
            F.lit("/100"))),
        F.when((parts["company_type"] >= 0.7) & F.lit(spec.is_technical(lexicon)),
               "product-company background")))
    tail = F.concat_ws("; ", match, F.array_join(F.slice(extras, 1, 2), "; "))
    tail = F.when(F.size(extras) == 0, match).otherwise(tail)
    lead = F.when(
        (fit < 0.35) & (parts["stuffer"] < 0.85),
        F.concat(role, F.lit("; "), match,
                 F.lit(" — skills list carries relevant keywords but the actual role and "
                       "history do not back them up; based in "), place, F.lit("."))
    ).otherwise(F.concat(role, F.lit("; "), tail, F.lit("; based in "), place, F.lit(".")))

    rate, notice = facts["response_rate"], facts["notice_days"]
    percent = F.concat(no_decimals(rate * 100.0), F.lit("%"))
    concerns = F.array_compact(F.array(
        F.when(rate < 0.25, F.concat(
            F.lit("low recruiter response rate ("), percent, F.lit(")"))),
        F.when(notice >= 90, F.concat(
            F.lit("long notice period ("), number_text(notice), F.lit("d)"))),
        F.when(parts["behavioral"] < 0.8, "weak recent platform activity"),
        F.when((parts["company_type"] <= 0.25) & (fit >= 0.5), "services-heavy background"),
        F.when(parts["n_reasons"] > 0, "profile has internal inconsistencies")))
    closing = (
        F.when(F.size(concerns) > 0, F.concat(
            F.lit("Concerns: "), F.array_join(F.slice(concerns, 1, 3), "; "), F.lit(".")))
        .when((rank <= 25) & F.coalesce(rate >= 0.5, F.lit(False)), F.concat(
            F.lit("Responsive on the platform (response rate "), percent, F.lit(").")))
        .when(rank <= 25, "Solid overall fit on role, experience and location."))
    return F.replace(collapse_spaces(F.concat_ws(" ", lead, closing)), F.lit('"'), F.lit("'"))


def domain_text(top: Column, lexicon: Lexicon) -> Column:
    """Labels of the top domains joined by commas, a dash when there is none."""
    joined = F.array_join(F.transform(top, lambda d: label_of(d, lexicon, d)), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("—"))
