"""Parameters of a ranking run: settings, lexicon and the parsed role."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from rosterlens import fixed_values as fv


@dataclass(frozen=True)
class Domain:
    """One occupational domain: phrases for titles, terms for prose."""

    name: str
    label: str
    titles: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lexicon:
    """Ordered domains. The order breaks ties between equal domain weights."""

    domains: tuple[Domain, ...]
    technical: frozenset[str] = frozenset(fv.TECH_DOMAINS)

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.domains]

    @property
    def labels(self) -> dict[str, str]:
        return {d.name: d.label for d in self.domains}

    @property
    def all_terms(self) -> list[str]:
        return list(dict.fromkeys(t for d in self.domains for t in d.terms))

    @classmethod
    def from_frame(cls, rows: DataFrame, technical=fv.TECH_DOMAINS) -> "Lexicon":
        """Read ``(domain, label, domain_idx, kind, phrase_idx, phrase)`` rows.

        ``kind`` is ``title`` or ``term``. The table is a dictionary, not data:
        its phrases become literals of the plan.
        """
        got = rows.orderBy("domain_idx", "kind", "phrase_idx").collect()
        domains: dict[str, dict] = {}
        for r in got:
            entry = domains.setdefault(
                r["domain"], {"label": r["label"], "title": [], "term": []})
            entry[r["kind"]].append(r["phrase"])
        return cls(
            tuple(Domain(name, e["label"], tuple(e["title"]), tuple(e["term"]))
                  for name, e in domains.items()),
            frozenset(technical))


@dataclass(frozen=True)
class Settings:
    """All adjustable values; the defaults are the fixed values."""

    weights: dict[str, float] = field(default_factory=lambda: dict(fv.WEIGHTS))
    consulting_companies: tuple[str, ...] = fv.CONSULTING_COMPANIES
    consulting_industries: tuple[str, ...] = fv.CONSULTING_INDUSTRIES
    product_industries: tuple[str, ...] = fv.PRODUCT_INDUSTRIES
    nontech_industries: tuple[str, ...] = fv.NONTECH_INDUSTRIES
    cities: tuple[str, ...] = fv.CITIES
    countries: tuple[str, ...] = fv.COUNTRIES
    exclusion_markers: tuple[str, ...] = fv.EXCLUSION_MARKERS
    specialties: tuple[str, ...] = fv.SPECIALTIES
    reference_date: str = fv.REFERENCE_DATE
    home_country: str = fv.HOME_COUNTRY
    stop_words: tuple[str, ...] | None = None   # None: Spark's English list
    title_length: int = fv.TITLE_LENGTH
    keyword_cap: int = fv.KEYWORD_CAP
    exclusion_window: int = fv.EXCLUSION_WINDOW
    min_df: int = fv.MIN_DF
    max_features: int | None = None             # None: every term; fv.MAX_FEATURES for a cap
    scale_percentile: float = fv.SCALE_PERCENTILE
    scale_min_rows: int = fv.SCALE_MIN_ROWS

    def normalised_weights(self) -> dict[str, float]:
        """Weights divided by their sum, as a re-weighting run uses them."""
        total = sum(self.weights.values()) or 1.0
        return {k: v / total for k, v in self.weights.items()}


@dataclass(frozen=True)
class JobSpec:
    """A parsed role description; its fields become literals of the plan."""

    title: str
    vector: tuple[float, ...]
    target_domains: tuple[str, ...]
    keywords: tuple[str, ...]
    exp_min: float
    exp_max: float
    exp_ideal: float
    cities: tuple[str, ...]
    countries: tuple[str, ...]
    excluded: tuple[str, ...]

    @property
    def has_location_pref(self) -> bool:
        return bool(self.cities or self.countries)

    def is_technical(self, lexicon: Lexicon) -> bool:
        return bool(lexicon.technical & set(self.target_domains))

    @classmethod
    def from_row(cls, row: Row) -> "JobSpec":
        return cls(
            title=row["title"],
            vector=tuple(row["vector"]),
            target_domains=tuple(row["target_domains"]),
            keywords=tuple(row["keywords"]),
            exp_min=row["exp_min"], exp_max=row["exp_max"], exp_ideal=row["exp_ideal"],
            cities=tuple(row["cities"]), countries=tuple(row["countries"]),
            excluded=tuple(row["excluded"]))
