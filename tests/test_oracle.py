"""Registered queries against their SQL on the smallest tables."""

import os
import sys
from dataclasses import replace

import pandas
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks import bindings  # noqa: E402
from checks.catalog import QUERIES, best_for  # noqa: E402
from checks.oracle import ORACLE  # noqa: E402
from checks.parameters import LEXICON, SETTINGS  # noqa: E402
from rosterlens.operators.dense import one_per_key  # noqa: E402
from rosterlens.operators.jobs import parse_job  # noqa: E402
from rosterlens.plans.rank_pool import rank_facts  # noqa: E402

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
CHECKED = ("prose_projection", "nested_facts", "lexicon_term_match", "jd_spec", "jd_exclusions",
           "percentile_scaling", "integrity_rules", "final_score", "rank_all", "explanation",
           "audit", "kpis", "validate_ok", "validate_broken", "validate_file", "nested_ranking",
           "tfidf_uncapped", "vectors_ranking", "csv_head", "jsonl_limited", "json_array")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(value):
    if pandas.isna(value):
        return ""
    is_number = isinstance(value, (int, float)) or hasattr(value, "dtype")
    return str(float(value)) if is_number else str(value)


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(
        tuple(map(text, row)) for row in frame.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"topk_per_jd"} and set(ORACLE) <= set(QUERIES)


def test_many_roles_equal_runs_for_one(spark):
    """``topk_per_jd`` has no SQL: some roles are run alone over the same customers."""
    got = {}
    for r in best_for(spark, SF, bindings.jobs(spark, SF)).collect():
        got.setdefault(r["jd_id"], []).append((r["rank"], r["candidate_id"], r["score"]))
    jobs = {r["jd_id"]: r["text"] for r in bindings.jobs(spark, SF).collect()}
    assert set(got) == set(jobs) and all(len(x) == 10 for x in got.values())
    settings = replace(SETTINGS, max_features=None)
    dense = one_per_key(bindings.dense(spark, SF), "candidate_id")
    for jd in (1, 60, 144, 199):
        spec = parse_job(spark, jobs[jd], LEXICON, settings)
        texts = bindings.text_features(spark, SF, spec.keywords)
        with rank_facts(bindings.pool(spark, SF, spec, texts), jobs[jd], LEXICON, settings, dense,
                        spec, texts) as run:
            want = run.top(10).select("rank", "candidate_id", "score").collect()
        assert sorted(got[jd]) == sorted(tuple(r) for r in want), jobs[jd]


def test_roles_of_ids_divisible_by_100_are_the_queries(spark):
    asked = bindings.jobs(spark, SF).where("jd_id % 100 = 0")
    got = sorted(map(tuple, QUERIES["topk_per_jd"](spark, SF).collect()))
    assert got == sorted(map(tuple, best_for(spark, SF, asked).collect()))
    assert {r[0] for r in got} == {r["jd_id"] for r in asked.collect()}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, database, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(database.execute(ORACLE[name]).df())
