"""Rank one pool against many role texts: the best of each role.

The corpus is read once: features of texts, frequencies of terms, vectors and facts of candidates.
A role is one document of its own corpus, which changes the document count by one and the document
frequency of its own terms by one. So a text's norm under a role is the corpus norm, put right at
the terms that both have; the result is that of a run for the role alone.

Roles are a stated query set. They meet the pool in blocks of ``ROLE_BLOCK``, each small enough to
be broadcast. Written for a block are a row for each of the pool, with its similarities to the
roles, and the best; pairs are scored twice instead (see ``operators.role_block``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from rosterlens.operators.facts import nested_facts
from rosterlens.operators.jobs import job_specs
from rosterlens.operators.ordering import grouped_percentiles
from rosterlens.operators.ranking import group_tops, normalised_per_group, top_per_group
from rosterlens.operators.role_block import RoleBlock, assessed_names, skill_bits
from rosterlens.operators.scoring import (
    combined, local_parts, semantic, with_domain_vector, with_own_gates)
from rosterlens.operators.text_features import of_pool, with_text_features
from rosterlens.operators.tfidf import (
    counted, frequencies, idf, role_terms, scale_percent, scaled_by, weight)
from rosterlens.settings import JobSpec, Lexicon, Settings
from rosterlens.sources.candidates import with_id
from rosterlens.sources.scratch import Scratch, materialise

ROLE_BLOCK = 256
BLOCK_WORDS = 1024   # different keywords of a block, if it has more than one role
_METHOD = "spark.sql.codegen.hugeMethodLimit"
NO_ROLE = JobSpec("", (), (), (), 0.0, 50.0, 0.0, (), (), ())


class Corpus:
    """Counted terms of the pool: frequencies, and squared norms without any role."""

    def __init__(self, terms: DataFrame, rows: int, settings: Settings, scratch: Scratch):
        if settings.max_features is not None:
            raise ValueError("a capped vocabulary differs from role to role: rank them one by one")
        self.terms, self.settings, self.scratch = terms, settings, scratch
        self.n = F.lit(float(rows + 1))   # the role's text is a document
        self.known = scratch.keep(frequencies(counted(terms, "row_id").select("term", "tf")))
        kept = self.known.where(F.col("df") >= settings.min_df).select(
            "term", idf(self.n, F.col("df")).alias("idf"))
        self.norms = scratch.keep(
            counted(terms, "row_id").join(kept, "term").groupBy("row_id").agg(
                F.sum(F.pow(weight(F.col("tf"), F.col("idf")), F.lit(2.0))).alias("sq")))

    def asked(self, roles: DataFrame) -> DataFrame:
        """``jd_id, term, old, new, q``: idf without and with the role, and the role's weight."""
        df = F.coalesce("df", F.lit(0))
        found = self.scratch.keep(
            role_terms(roles, "jd_id", "text", self.settings).join(self.known, "term", "left"))
        terms = found.where(df + 1 >= self.settings.min_df).select(
            "jd_id", "term", F.when(df >= self.settings.min_df, idf(self.n, df)).alias("old"),
            idf(self.n, df + 1).alias("new"), "tf")
        w = weight(F.col("tf"), F.col("new"))
        norms = terms.groupBy("jd_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
        return self.scratch.keep(terms.join(norms, "jd_id").select(
            "jd_id", "term", "old", "new", (w / F.col("norm")).alias("q")))

    def shared(self, asked: DataFrame) -> DataFrame:
        """``row_id, sq, term, tf`` of the terms that some role has, with the row's squared norm.

        The roles' terms are written: their size tells Spark to drop all others where they are read.
        """
        words = self.scratch.keep(asked.select("term").distinct())
        met = counted(self.terms, "row_id").join(words, "term", "left_semi")
        return self.scratch.keep(met.join(self.norms, "row_id", "left").select(
            "row_id", F.coalesce("sq", F.lit(0.0)).alias("sq"), "term", "tf"))


def similarities(shared: DataFrame, asked: DataFrame, tasks: int) -> DataFrame:
    """``row_id, place, tfidf`` of all pairs with a common term. Only shared terms are exchanged:
    a row's terms are in one task, and there its pairs are added up."""
    one = F.lit(1.0) + F.log(F.col("tf").cast("double"))
    pairs = shared.repartition(tasks, "row_id").join(F.broadcast(asked), "term").groupBy(
        "row_id", "sq", "place").agg(
        F.sum(one * F.col("new") * F.col("q")).alias("dot"),
        F.sum(F.pow(one * F.col("new"), F.lit(2.0))
              - F.coalesce(F.pow(one * F.col("old"), F.lit(2.0)), F.lit(0.0))).alias("more"))
    return pairs.where("dot > 0").select(
        "row_id", "place", (F.col("dot") / F.sqrt(F.col("sq") + F.col("more"))).alias("tfidf"))


def best_per_role(facts: DataFrame, roles: DataFrame, lexicon: Lexicon, settings: Settings,
                  k: int, terms: DataFrame | None = None,
                  dense: DataFrame | None = None) -> DataFrame:
    """``jd_id, rank, candidate_id, row_id, score``: the ``k`` best of each role.

    ``facts`` are those of ``nested_facts`` with keywords and of ``with_text_features``; counted
    terms are a column of theirs or in ``terms`` by ``row_id``. ``roles`` have ``jd_id`` (unique)
    and the columns of ``job_specs``. A dense similarity, if any, is the same for every role.
    """
    with Scratch(facts.sparkSession) as scratch, _compiled(facts.sparkSession):
        pool = scratch.keep(with_own_gates(with_domain_vector(facts, lexicon), settings))
        rows = pool.count()
        texts = pool.select("row_id", "terms") if terms is None else of_pool(
            terms.select("row_id", "terms"), pool, "row_id", scratch)
        corpus = Corpus(texts, rows, settings, scratch)
        asked = corpus.asked(roles.select("jd_id", "text"))
        shared = corpus.shared(asked)
        own = pool.drop("terms")
        if dense is not None:   # it goes with the candidate, not with the pair
            own = scratch.keep(own.join(dense, "candidate_id", "left"))
        named, bits = assessed_names(pool), skill_bits(pool)
        best = []
        for part in _blocks(roles):
            block = RoleBlock(part, lexicon, settings, named, bits)
            placed = block.placed(roles)
            sims = similarities(shared, placed.select("jd_id", "place").join(asked, "jd_id"),
                                _tasks(pool))
            met = scratch.keep(_spread(block.rows(own)).join(block.near(sims), "row_id", "left"))
            tops = grouped_percentiles(
                met.select(F.inline("near")), "place", "tfidf", F.lit(rows),
                scale_percent(F.lit(rows), settings), scratch)
            specs = scratch.keep(block.specs(placed).join(tops, "place", "left"))
            scored = _scored(met, specs, block)
            largest = scratch.keep(group_tops(scored, "jd_id", "row_id", k))
            best.append(scratch.keep(top_per_group(
                normalised_per_group(scored, "jd_id", F.broadcast(largest)), "jd_id", k).select(
                "jd_id", "rank", "candidate_id", "row_id", "score")))
            scratch.drop(met)
        if not best:
            return facts.sparkSession.createDataFrame(
                [], "jd_id long, rank int, candidate_id string, row_id long, score double")
        out = best[0]
        for more in best[1:]:
            out = out.union(more)
        return materialise(out)


@contextmanager
def _compiled(spark: SparkSession) -> Iterator[None]:
    """A pair takes more code than the JVM compiles as one method (8,000 bytes), and took six times
    longer so. Beyond that size Spark is to cut expressions into methods."""
    before = spark.conf.get(_METHOD, "65535")
    spark.conf.set(_METHOD, "8000")
    try:
        yield
    finally:
        spark.conf.set(_METHOD, before)


def _blocks(roles: DataFrame) -> list[list[Row]]:
    """The stated set by ``jd_id``, in blocks of ``ROLE_BLOCK`` roles or of ``BLOCK_WORDS`` words."""
    blocks: list[list[Row]] = []
    words: set[str] = set()
    for r in sorted(roles.select("jd_id", "keywords", "cities", "countries", "excluded").collect(),
                    key=lambda r: r["jd_id"]):
        more = words.union(r["keywords"] or ())
        if not blocks or len(blocks[-1]) == ROLE_BLOCK or len(more) > BLOCK_WORDS:
            blocks.append([])
            more = set(r["keywords"] or ())
        blocks[-1].append(r)
        words = more
    return blocks


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _spread(rows: DataFrame) -> DataFrame:
    """Each row becomes a block of pairs: spread them first, however little the rows themselves are."""
    return rows.repartition(_tasks(rows), "row_id")


def _scored(met: DataFrame, specs: DataFrame, block: RoleBlock) -> DataFrame:
    """``jd_id, row_id, candidate_id, final`` of all pairs with the roles of a block.

    They are not written: to score them again costs less.
    """
    pairs = met.crossJoin(F.broadcast(specs))
    pairs = block.facts(pairs.withColumn("tfidf", scaled_by(
        block.similarity(), F.coalesce("value", F.lit(0.0)))))
    parts = local_parts(pairs, block.role(), block.lexicon, block.settings, block.met())
    return combined(semantic(parts, None, None, "row_id"), block.settings.weights).select(
        "jd_id", "row_id", "candidate_id", "final")


def rank_pool_for_roles(candidates: DataFrame, jobs: DataFrame, lexicon: Lexicon,
                        settings: Settings | None = None, k: int = 100,
                        dense: DataFrame | None = None) -> DataFrame:
    """The ``k`` best nested candidate records for each ``(jd_id, text)`` of ``jobs``."""
    settings = settings or Settings()
    roles = materialise(job_specs(jobs, lexicon, settings))
    keywords = asked_keywords(roles)
    facts = with_text_features(
        nested_facts(with_id(candidates), NO_ROLE, lexicon, settings, keywords), "prose", lexicon,
        keywords, settings)
    return best_per_role(facts, roles, lexicon, settings, k, dense=dense)


def asked_keywords(roles: DataFrame) -> tuple[str, ...]:
    """Keywords of all roles: phrases of the lexicon, so no more than it has."""
    found = roles.select(F.explode("keywords").alias("k")).distinct().orderBy("k").collect()
    return tuple(r["k"] for r in found)
