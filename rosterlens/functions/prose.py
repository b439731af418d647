"""Text of a candidate that counts as evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlens.functions.basics import collapse_spaces


def candidate_prose(profile: Column, history: Column, education: Column) -> Column:
    """Headline, summary, titles, descriptions, industries, fields of study.

    The skills list stays out on purpose: it is the easiest part to stuff.
    """
    own = F.array(*[profile[f] for f in (
        "headline", "summary", "current_title", "current_industry")])
    roles = F.flatten(F.transform(
        history, lambda r: F.array(r["title"], r["description"], r["industry"])))
    studies = F.transform(education, lambda e: e["field_of_study"])
    parts = F.concat(own, F.coalesce(roles, F.array().cast("array<string>")),
                     F.coalesce(studies, F.array().cast("array<string>")))
    return F.lower(collapse_spaces(F.array_join(F.filter(parts, lambda x: x != ""), " ")))
