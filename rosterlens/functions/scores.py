"""Score components, gates and their combination.

Every function takes columns of the facts frame (see ``operators.facts``) and a
role: the literals of a parsed one, or columns of the row. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from rosterlens import fixed_values as fv
from rosterlens.functions.basics import (
    clamp, contains_any, flag, let, lower_text, number, strings)
from rosterlens.functions.roles import Role, columns_of
from rosterlens.settings import JobSpec, Lexicon, Settings


def role_fit(cosine: Column) -> Column:
    return clamp(cosine, 0.0, 1.0)


def experience(yoe: Column, role: Role) -> Column:
    r = columns_of(role)
    lo, hi = r.exp_min, r.exp_max
    centre = F.when(r.exp_ideal > 0, r.exp_ideal).otherwise((lo + hi) / 2.0)
    half = F.greatest(F.lit(1.0), (hi - lo) / 2.0)
    years = number(yoe)
    within = F.greatest(F.lit(0.82), 1.0 - F.lit(0.18) * F.abs(years - centre) / half)
    gap = F.when(years < lo, lo - years).otherwise(years - hi)
    outside = F.greatest(F.lit(0.08), 0.80 - F.lit(0.13) * gap)
    return (F.when((lo <= 0) & (hi >= 50), 0.7)
            .when(years.between(lo, hi), within).otherwise(outside))


def holds_any(text: Column, needles: Column) -> Column:
    """Unbounded substring test against an array."""
    return let(text, lambda t: F.exists(needles, lambda n: F.contains(t, n)))


def location(place: Column, country: Column, relocate: Column, role: Role,
             settings: Settings) -> Column:
    r = columns_of(role)
    return located(holds_any(lower_text(place), r.cities),
                   holds_any(lower_text(country), countries_of(r, settings)), relocate, r)


def countries_of(role: Role, settings: Settings) -> Column:
    """Countries of the role, the home country if it names none."""
    r = columns_of(role)
    return F.when(r.n_countries > 0, r.countries).otherwise(
        strings([settings.home_country.lower()]))


def located(in_city: Column, in_country: Column, relocate: Column, role: Role) -> Column:
    """:func:`location` from what is known of the place."""
    r = columns_of(role)
    at_home = F.when(r.n_cities > 0, F.when(flag(relocate), 0.78).otherwise(0.68)).otherwise(0.82)
    return (F.when((r.n_cities == 0) & (r.n_countries == 0), 0.7)
            .when(in_city, 1.0)
            .when(in_country, at_home)
            .when(flag(relocate), 0.35)
            .otherwise(0.15))


def phrases_found(text: Column, phrases: Iterable[str]) -> Column:
    """Which of the phrases the text holds, in their order."""
    return let(text, lambda t: F.filter(strings(phrases), lambda k: F.contains(t, k)))


def evidence_found(prose: Column, spec: JobSpec) -> Column:
    """Keywords of the role that occur in the prose, in keyword order."""
    return phrases_found(prose, spec.keywords)


def evidence(found: Column, role: Role) -> Column:
    return evidence_share(F.size(found), role)


def evidence_share(n_found: Column, role: Role) -> Column:
    asked = columns_of(role).n_keywords
    enough = F.least(F.lit(10.0), F.greatest(F.lit(5.0), asked * F.lit(0.4)))
    return F.when(asked == 0, 0.5).otherwise(F.least(F.lit(1.0), n_found / enough))


def employer_class(company: Column, industry: Column, settings: Settings) -> Column:
    """``consulting``, ``product``, ``nontech`` or ``other``; first rule wins."""
    return let(F.struct(lower_text(company).alias("c"), lower_text(industry).alias("i")),
               lambda r: F.when(
                   contains_any(r["c"], settings.consulting_companies)
                   | contains_any(r["i"], settings.consulting_industries), "consulting")
               .when(contains_any(r["i"], settings.product_industries), "product")
               .when(contains_any(r["i"], settings.nontech_industries), "nontech")
               .otherwise("other"))


def company_type(n_roles: Column, consulting: Column, product: Column, nontech: Column,
                 industry: Column, role: Role, lexicon: Lexicon,
                 settings: Settings) -> Column:
    return if_technical(employers(n_roles, consulting, product, nontech, industry, settings),
                        role, lexicon)


def if_technical(of_employers: Column, role: Role, lexicon: Lexicon) -> Column:
    return F.when(columns_of(role).is_technical(lexicon), of_employers).otherwise(0.65)


def employers(n_roles: Column, consulting: Column, product: Column, nontech: Column,
              industry: Column, settings: Settings) -> Column:
    """:func:`company_type` for a technical role: no role changes it."""
    n = F.nullif(n_roles, F.lit(0))
    share = (0.45 + F.lit(0.55) * (product / n) - F.lit(0.30) * (consulting / n)
             - F.lit(0.45) * (nontech / n))
    capped = F.when((consulting == n_roles) & (n_roles >= 2),
                    F.least(share, F.lit(0.18))).otherwise(share)
    capped = F.when((nontech / n >= 0.8) & (product == 0),
                    F.least(capped, F.lit(0.20))).otherwise(capped)
    no_roles = F.when(contains_any(lower_text(industry), settings.product_industries),
                      0.5).otherwise(0.3)
    return F.when(n_roles == 0, no_roles).otherwise(clamp(capped, 0.0, 1.0))


def stuffing(skill_hits: Column, fit: Column) -> Column:
    severity = F.least(F.lit(1.0), skill_hits / F.lit(8.0)) * (0.45 - fit) / F.lit(0.45)
    return F.when((skill_hits >= 4) & (fit < 0.45),
                  1.0 - F.lit(fv.STUFFING_MAX) * severity).otherwise(F.lit(1.0))


def excluded_specialty(title: Column, evidence_score: Column, role: Role) -> Column:
    return excluded_if(holds_any(lower_text(title), columns_of(role).excluded), evidence_score)


def excluded_if(named: Column, evidence_score: Column) -> Column:
    softened = F.when(evidence_score >= 0.9, 0.80).otherwise(0.60)
    return F.when(named, softened).otherwise(1.0)


def job_hopping(n_completed: Column, completed_months: Column) -> Column:
    mean = completed_months / F.nullif(n_completed, F.lit(0))
    return (F.when((n_completed >= 3) & (mean < 16), 0.85)
            .when((n_completed >= 4) & (mean < 20), 0.92)
            .otherwise(1.0))


def recency(last_active: Column, settings: Settings) -> Column:
    """Bucket of whole calendar months before the reference date."""
    def part(col: Column, at: int, width: int) -> Column:
        return F.substring(col, at, width).try_cast("int")

    ref_year, ref_month = int(settings.reference_date[:4]), int(settings.reference_date[5:7])
    months = ((F.lit(ref_year) - part(last_active, 1, 4)) * 12
              + (F.lit(ref_month) - part(last_active, 6, 2)))
    return let(months, lambda m: F.when(m.isNull(), 0.5).when(m <= 1, 1.0)
               .when(m <= 3, 0.85).when(m <= 6, 0.6).when(m <= 12, 0.3).otherwise(0.12))


def availability(response_rate: Column, last_active: Column, open_to_work: Column,
                 interview_rate: Column, notice_days: Column, completeness: Column,
                 email_ok: Column, phone_ok: Column, settings: Settings) -> Column:
    """Weighted mean over the signals that are present, mapped to the gate."""
    notice = (F.when(notice_days <= 30, 1.0).when(notice_days <= 60, 0.8)
              .when(notice_days <= 90, 0.6).otherwise(0.4))
    verified = (flag(email_ok).cast("double") + flag(phone_ok).cast("double")) / 2.0
    always = F.lit(True)
    terms = [
        (0.30, response_rate.isNotNull(), F.least(F.lit(1.0), response_rate / 0.6)),
        (0.25, always, recency(last_active, settings)),
        (0.12, always, F.when(flag(open_to_work), 1.0).otherwise(0.55)),
        (0.10, interview_rate.isNotNull(), F.least(F.lit(1.0), interview_rate)),
        (0.10, notice_days.isNotNull(), notice),
        (0.07, completeness.isNotNull(), F.least(F.lit(1.0), completeness / 90.0)),
        (0.06, always, verified),
    ]
    weight, total = F.lit(0.0), F.lit(0.0)
    for w, present, value in terms:
        weight = weight + F.when(present, w).otherwise(0.0)
        total = total + F.when(present, F.lit(w) * value).otherwise(0.0)
    return (F.lit(fv.AVAILABILITY_MIN)
            + F.lit(fv.AVAILABILITY_MAX - fv.AVAILABILITY_MIN) * (total / weight))


def assessment_mean(rel_n: Column, rel_sum: Column, all_n: Column, all_sum: Column) -> Column:
    """Mean over the role's skills, else over all skills, else null."""
    return F.when(rel_n > 0, rel_sum / F.nullif(rel_n, F.lit(0))).otherwise(
        all_sum / F.nullif(all_n, F.lit(0)))


def corroboration(mean: Column, github: Column, role: Role, lexicon: Lexicon) -> Column:
    # least and greatest skip nulls, so a missing mean needs its own branch
    assessed = F.when(mean.isNotNull(), clamp((mean - 55.0) / 35.0, -0.5, 1.0)).otherwise(0.0)
    shown = F.when((github >= 0) & columns_of(role).is_technical(lexicon),
                   clamp((github - 35.0) / 45.0, -0.3, 1.0)).otherwise(0.0)
    return clamp(1.0 + F.lit(0.05) * assessed + F.lit(0.03) * shown, 0.95, 1.08)


def weighted_base(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = None
    for name in fv.WEIGHTS:
        term = F.lit(weights[name]) * parts[name]
        total = term if total is None else total + term
    return total


def gated(base: Column, behavioral: Column, verified: Column, stuffer: Column,
          negative: Column, hop: Column, soft: Column, hard: Column) -> Column:
    product = base * behavioral * verified * stuffer * negative * hop * soft
    return product * F.when(hard, F.lit(fv.IMPOSSIBLE_MULTIPLIER)).otherwise(F.lit(1.0))


def blended(tfidf: Column, dense: Column) -> Column:
    """Half and half where a dense similarity exists, else TF-IDF alone."""
    return F.coalesce(F.lit(0.5) * tfidf + F.lit(0.5) * dense, tfidf)


def bare_name(name: Column) -> Column:
    """A skill name as it is compared with keywords: trimmed, in lower case."""
    return F.lower(F.btrim(F.coalesce(name, F.lit("")), F.lit(" \t\n\r\x0b\x0c")))


def keyword_match(name: Column, spec: JobSpec) -> Column:
    """Exact match of a trimmed, lower-cased skill name with a role keyword."""
    if not spec.keywords:
        return F.lit(False)
    return bare_name(name).isin(list(spec.keywords))
