"""End-to-end plans: rank a pool of candidates against a role text."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from rosterlens.operators import audit as views
from rosterlens.operators.facts import nested_facts
from rosterlens.operators.jobs import parse_job
from rosterlens.operators.ranking import all_ranked, normalised, top_ranked
from rosterlens.operators.scoring import combined, local_parts, semantic
from rosterlens.operators.text_features import of_pool, with_text_features
from rosterlens.operators.tfidf import percentile_scaled, similarities
from rosterlens.settings import JobSpec, Lexicon, Settings
from rosterlens.sources.candidates import require_rows, with_id
from rosterlens.sources.scratch import Scratch
from rosterlens.sources.vectors import dense_of


@dataclass(frozen=True)
class Ranking:
    """A scored pool. ``parts`` is a written table, one row per candidate.

    It lies in the run's scratch folder until :meth:`close`, or until the session ends. A run is
    also a context manager: ``with rank_pool(...) as run``.
    """

    parts: DataFrame
    spec: JobSpec
    lexicon: Lexicon
    settings: Settings
    weights: dict[str, float]
    scratch: Scratch = field(repr=False)

    @property
    def scores(self) -> DataFrame:
        return normalised(self.parts)

    def top(self, k: int = 100) -> DataFrame:
        """The k best, explained. Sentences are built for these rows only."""
        return views.explained(top_ranked(self.scores, k), self.spec, self.lexicon, self.settings)

    def ranks(self) -> DataFrame:
        """``row_id, candidate_id, score, rank`` of the whole pool."""
        return all_ranked(self.scores, self.scratch)

    def everyone(self) -> DataFrame:
        """The whole pool, ranked and explained: the shown columns joined to the ranks."""
        shown = self.parts.drop("candidate_id")
        return views.explained(self.ranks().join(shown, "row_id"), self.spec, self.lexicon,
                               self.settings)

    def audit(self, k: int | None = None) -> DataFrame:
        rows = self.everyone() if k is None else self.top(k)
        return views.audit(rows, self.lexicon)

    def reweighted(self, weights: dict[str, float]) -> "Ranking":
        """Score again with other weights; texts are not fitted again. Shares this run's folder."""
        settings = replace(self.settings, weights=weights)
        chosen = settings.normalised_weights()
        again = self.scratch.keep(combined(self.parts.drop("base", "final"), chosen))
        return replace(self, parts=again, settings=settings, weights=chosen)

    def close(self) -> None:
        """Delete the tables of the run."""
        self.scratch.close()

    def __enter__(self) -> "Ranking":
        return self

    def __exit__(self, *error) -> None:
        self.close()


def score_facts(facts: DataFrame, spec: JobSpec, role_text: str, lexicon: Lexicon,
                settings: Settings, dense: DataFrame | None, features: DataFrame | None,
                scratch: Scratch) -> DataFrame:
    """Scored pool as a written table.

    ``facts`` carry the features of their texts. Their counted terms are a column ``terms``, or
    are in ``features`` by ``row_id``. Tables are written where the plan would otherwise repeat
    work (row-local parts, frequencies, similarities, scores), all but the last deleted again.
    """
    local = scratch.keep(local_parts(facts, spec, lexicon, settings))
    texts = local.select("row_id", "terms") if features is None else of_pool(
        features.select("row_id", "terms"), local, "row_id", scratch)
    sims = scratch.keep(similarities(texts, "row_id", role_text, settings, local, scratch))
    scaled = percentile_scaled(sims, "tfidf", "_scaled", settings, scratch).select(
        "row_id", F.col("_scaled").alias("tfidf"))
    joined = semantic(local.drop("terms"), scaled, dense, "row_id")
    scored = scratch.keep(combined(joined, settings.weights))
    scratch.drop_all_but(scored)
    return scored


def rank_facts(facts: DataFrame, role_text: str, lexicon: Lexicon, settings: Settings,
               dense: DataFrame | None = None, spec: JobSpec | None = None,
               features: DataFrame | None = None) -> Ranking:
    """Rank facts with the features of their texts (see :func:`score_facts`)."""
    spec = spec or parse_job(facts.sparkSession, role_text, lexicon, settings)
    scratch = Scratch(facts.sparkSession)
    try:
        parts = score_facts(facts, spec, role_text, lexicon, settings, dense, features, scratch)
    except BaseException:
        scratch.close()
        raise
    return Ranking(parts, spec, lexicon, settings, settings.weights, scratch)


def rank_pool(candidates: DataFrame, role_text: str, lexicon: Lexicon,
              settings: Settings | None = None, dense: DataFrame | None = None,
              at_least: int | None = None, vectors: str | None = None) -> Ranking:
    """Rank nested candidate records.

    ``dense`` is an optional ``(candidate_id, dense)`` frame with one row per id; ``vectors`` is
    the path of a vector artifact, from which it is taken instead: a missing path is no error.
    ``at_least`` fails the run when the pool is smaller.
    """
    settings = settings or Settings()
    pool = with_id(candidates)
    spark = pool.sparkSession
    if at_least is not None:
        require_rows(pool, at_least)
    spec = parse_job(spark, role_text, lexicon, settings)
    facts = with_text_features(nested_facts(pool, spec, lexicon, settings), "prose", lexicon,
                               spec.keywords, settings)
    return rank_facts(facts, role_text, lexicon, settings,
                      dense if vectors is None else dense_of(spark, vectors), spec)
