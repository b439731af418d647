"""Rules that find impossible records, and their verdict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlens.functions.basics import no_decimals, number, number_text, one_decimal

MASTERY = ("expert", "advanced")


def overlong(months: Column, yoe: Column) -> Column:
    """A role longer than the whole career plus a year of slack."""
    career = number(yoe) * 12.0
    return (career > 0) & (number(months) > career + 12)


def year_of(date: Column) -> Column:
    """Leading four-digit year; null, unreadable and zero years are skipped."""
    return F.nullif(F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def span_months(start: Column, end: Column) -> Column:
    return (year_of(end) - year_of(start)) * 12


def misdated(months: Column, span: Column) -> Column:
    """Claimed duration beyond the span of the role's own years."""
    return F.coalesce(number(months) > span + 30, F.lit(False))


def idle_mastery(proficiency: Column, months: Column) -> Column:
    """Top proficiency with exactly zero months of use (null is not zero)."""
    return F.lower(F.coalesce(proficiency, F.lit(""))).isin(*MASTERY) & \
        F.coalesce(months == 0, F.lit(False))


def overlap(n_roles: Column, total_months: Column, yoe: Column) -> Column:
    career = number(yoe) * 12.0
    return (career > 0) & (total_months > career * 2.0) & (n_roles >= 2)


def hard_finding(first_overlong: Column, n_roles: Column, total_months: Column,
                 mastery_zero: Column, first_misdated: Column, yoe: Column) -> Column:
    return (first_overlong.isNotNull() | overlap(n_roles, total_months, yoe)
            | (mastery_zero >= 5) | first_misdated.isNotNull())


def reasons(first_overlong: Column, n_roles: Column, total_months: Column,
            mastery_zero: Column, first_misdated: Column, yoe: Column) -> Column:
    """Findings in rule order; hard findings are listed here as well."""
    zero = mastery_zero.cast("string")
    return F.array_compact(F.array(
        F.when(first_overlong.isNotNull(), F.concat(
            F.lit("role '"), first_overlong["title"], F.lit("' lasts "),
            number_text(first_overlong["months"]), F.lit("mo but total experience is only "),
            one_decimal(number(yoe)), F.lit("y"))),
        F.when(overlap(n_roles, total_months, yoe), F.concat(
            F.lit("career roles sum to "), number_text(total_months), F.lit("mo vs "),
            no_decimals(number(yoe) * 12.0),
            F.lit("mo of stated experience (impossible overlap)"))),
        F.when(mastery_zero >= 5, F.concat(
            zero, F.lit(" skills marked expert/advanced with 0 months used")))
        .when(mastery_zero >= 3, F.concat(
            zero, F.lit(" expert/advanced skills with 0 months used"))),
        F.when(first_misdated.isNotNull(), F.concat(
            F.lit("role '"), first_misdated["title"], F.lit("' claims "),
            number_text(first_misdated["months"]), F.lit("mo over a "),
            first_misdated["span"].cast("string"), F.lit("mo date span")))))


def finding_count(first_overlong: Column, n_roles: Column, total_months: Column,
                  mastery_zero: Column, first_misdated: Column, yoe: Column) -> Column:
    """Number of findings: the size of :func:`reasons` without its texts."""
    return sum((found.cast("int") for found in (
        first_overlong.isNotNull(), overlap(n_roles, total_months, yoe), mastery_zero >= 3,
        first_misdated.isNotNull())), start=F.lit(0))


def soft_penalty(n_reasons: Column) -> Column:
    return F.greatest(F.lit(0.6), 1.0 - F.lit(0.2) * n_reasons)
