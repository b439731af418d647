"""Parameters the registered queries run with, shared with their SQL oracles."""

from __future__ import annotations

from rosterlens import Domain, Lexicon, Settings

NOUNS = ("widget", "ring", "rod", "gear", "bolt", "plate", "gizmo", "anvil")
ADJECTIVES = ("small", "blue", "new", "cold", "hot", "old", "red", "large")
TERMS = {
    "widget": ("that", "with", "from", "this", "was", "for", "are", "click", "purchase"),
    "ring": ("from", "this", "signup"),
    "rod": ("was", "for"),
    "gear": ("are", "by"),
    "bolt": ("at", "on"),
}
LEXICON = Lexicon(
    tuple(Domain(n, f"{n} work", (n, *[f"{a} {n}" for a in ADJECTIVES]), TERMS.get(n, ()))
          for n in NOUNS),
    frozenset({"widget", "ring"}))

KINDS = ("standard", "promo", "small", "economy", "medium", "large")
SETTINGS = Settings(
    consulting_companies=("supplier 1",), consulting_industries=("standard",),
    product_industries=("economy", "promo", "large"), nontech_industries=("small", "medium"),
    cities=("nation_1", "nation_2", "nation_13"), countries=("asia", "europe"),
    specialties=(*KINDS, "gizmo", "gear"),
    reference_date="2001-09-20", home_country="asia", max_features=40_000,
    stop_words=("the", "and", "of", "to", "in", "is", "on", "at", "by", "as", "it", "an", "or",
                "be", "are", "was", "for", "with", "from"))

# The pool is ranked against this text followed by benchmark item 0.
ROLE_HEAD = """Role: small widget lead
5-9 years. Based in nation_1 or nation_2, asia
Skills: hot widget, red widget, small widget, blue widget, old widget; click, purchase
We do NOT want: gizmo work; or promo.
"""
OTHER_WEIGHTS = {"role_fit": 0.3, "semantic": 0.3, "evidence": 0.3, "experience": 0.2,
                 "company_type": 0.1, "location": 0.05}
