"""Rank large pools of candidate profiles against role descriptions on Spark."""

from rosterlens.plans.rank_pool import Ranking, rank_facts, rank_pool
from rosterlens.settings import Domain, JobSpec, Lexicon, Settings

__all__ = ["Domain", "JobSpec", "Lexicon", "Ranking", "Settings", "rank_facts", "rank_pool"]
