"""Domain vectors: phrase hits in titles, term hits in prose, cosine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlens.functions.basics import let, strings
from rosterlens.settings import Lexicon

CURRENT_TITLE_WEIGHT = 4.0
TERM_WEIGHT = 0.4
TERM_CAP = 2.5


def _quote(ch: str) -> str:
    return ch if ch.isalnum() or ch in " _" else "\\" + ch


def _branches(words: set[str], shortest: bool = False) -> str:
    """Alternatives sharing prefixes; a longer word is always tried first.

    Words that match at one position are prefixes of each other, so trying the
    deepest branch first is the same as trying the list sorted by length, at
    the cost of one character test per step instead of one per word. With
    ``shortest`` a word ends its branch: enough to see that some word stands here.
    """
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    if not heads or (shortest and "" in words):
        return ""
    arms = [_quote(c) + _branches(tails, shortest) for c, tails in sorted(heads.items())]
    body = arms[0] if len(arms) == 1 and "" not in words else "(?:" + "|".join(arms) + ")"
    return body + "?" if "" in words else body


def term_pattern(terms: list[str]) -> str:
    """One alternation over all terms with alphanumeric boundaries."""
    return r"(?<![a-z0-9])(" + _branches(set(terms)) + r")(?![a-z0-9])"


def title_hits(title: Column, lexicon: Lexicon) -> Column:
    """array<int>, one 0/1 per domain: does the lower-cased title name it?

    The phrases of a domain are one automaton, so the time for a title does not grow with them.
    """
    return F.array(*[
        (title.rlike(_branches(set(d.titles), shortest=True)) if d.titles else F.lit(False))
        .cast("int") for d in lexicon.domains])


def no_hits(lexicon: Lexicon) -> Column:
    return F.array_repeat(F.lit(0), len(lexicon.domains))


def matched_terms(prose: Column, lexicon: Lexicon) -> Column:
    """Distinct lexicon terms of lower-cased prose, longest match first."""
    if not lexicon.all_terms:
        return strings([])
    return F.array_distinct(
        F.regexp_extract_all(prose, F.lit(term_pattern(lexicon.all_terms)), F.lit(1)))


def term_counts(matched: Column, lexicon: Lexicon) -> Column:
    """array<int>: matched terms per domain; a term may serve two domains."""
    def held(found: Column, terms: tuple[str, ...]) -> Column:
        whole = "^(?:" + _branches(set(terms)) + ")$"
        return F.size(F.filter(found, lambda t: t.rlike(whole)))

    return let(matched, lambda found: F.array(*[
        held(found, d.terms) if d.terms else F.lit(0) for d in lexicon.domains]))


def unit(vector: Column, size: int) -> Column:
    """Divide by the Euclidean norm; a zero vector stays zero."""
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(norm, lambda n: F.when(
            n <= 1e-9, F.array_repeat(F.lit(0.0), size)).otherwise(
                F.transform(v, lambda x: x / n)))
    return let(vector, scaled)


def domain_vector(title: Column, past_hits: Column, term_hits: Column,
                  lexicon: Lexicon) -> Column:
    """Unit vector over the domains.

    ``title`` is the current title (lower case), ``past_hits`` the number of
    past titles naming each domain, ``term_hits`` that of the terms in the text.
    """
    titles = F.zip_with(title_hits(title, lexicon), past_hits,
                        lambda now, past: now * F.lit(CURRENT_TITLE_WEIGHT) + past)
    raw = F.zip_with(titles, term_hits,
                     lambda a, n: a + F.least(F.lit(TERM_CAP), F.lit(TERM_WEIGHT) * n))
    return unit(raw, len(lexicon.domains))


def text_hits(text: Column, lexicon: Lexicon) -> Column:
    """array<int>: lexicon terms per domain in lower-cased text."""
    return term_counts(matched_terms(text, lexicon), lexicon)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def top_positions(vector: Column, k: int, threshold: float) -> Column:
    """Positions (0-based) of the k largest entries, then those >= threshold."""
    ranked = F.array_sort(F.transform(vector, lambda x, i: F.struct(
        (-x).alias("neg"), i.alias("pos"))))
    kept = F.filter(F.slice(ranked, 1, k), lambda s: -s["neg"] >= threshold)
    return F.transform(kept, lambda s: s["pos"])


def top_domains(vector: Column, lexicon: Lexicon, k: int = 2, threshold: float = 0.15) -> Column:
    names = strings(lexicon.names)
    return F.transform(top_positions(vector, k, threshold), lambda p: F.get(names, p))


def label_of(domain: Column, lexicon: Lexicon, default: Column) -> Column:
    """Display label of a domain name."""
    chain = None
    for name, label in lexicon.labels.items():
        chain = (F.when(domain == name, label) if chain is None
                 else chain.when(domain == name, label))
    return default if chain is None else chain.otherwise(default)
