"""A role's specification as columns: literals of one parsed role, or fields of a table of roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from rosterlens.functions.basics import strings
from rosterlens.settings import JobSpec, Lexicon


@dataclass(frozen=True)
class RoleColumns:
    """What the scores look at. ``target_domains`` decide whether a role is technical."""

    vector: Column
    target_domains: Column
    keywords: Column
    exp_min: Column
    exp_max: Column
    exp_ideal: Column
    cities: Column
    countries: Column
    excluded: Column

    @classmethod
    def of(cls, spec: JobSpec) -> "RoleColumns":
        return cls(
            F.array(*[F.lit(v) for v in spec.vector]).cast("array<double>"),
            strings(spec.target_domains), strings(spec.keywords),
            *[F.lit(float(x)) for x in (spec.exp_min, spec.exp_max, spec.exp_ideal)],
            strings(spec.cities), strings(spec.countries), strings(spec.excluded))

    @classmethod
    def in_row(cls, struct: str) -> "RoleColumns":
        """Fields of a struct column with the columns of ``job_specs``."""
        return cls(**{name: F.col(struct)[name] for name in cls.__dataclass_fields__})

    def is_technical(self, lexicon: Lexicon) -> Column:
        return F.arrays_overlap(self.target_domains, strings(sorted(lexicon.technical)))

    @property
    def n_keywords(self) -> Column:
        return F.size(self.keywords)

    @property
    def n_cities(self) -> Column:
        return F.size(self.cities)

    @property
    def n_countries(self) -> Column:
        return F.size(self.countries)


Role = JobSpec | RoleColumns


def columns_of(role: Role) -> RoleColumns:
    return RoleColumns.of(role) if isinstance(role, JobSpec) else role
