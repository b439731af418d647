"""Many roles: what is looked up for a pair, which rows can be among the best, terms of roles."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlens import Settings
from rosterlens.operators.ranking import group_tops, normalised_per_group, top_per_group
from rosterlens.operators.role_block import Words
from rosterlens.operators.tfidf import role_terms
from rosterlens.plans import rank_many


def test_terms_of_roles_are_counted_once_however_often_a_filter_looks_at_them(spark):
    text = " ".join(f"word{i % 90}" for i in range(300))
    roles = spark.createDataFrame([(1, text)], "jd_id int, text string").repartition(1)
    terms = role_terms(roles, "jd_id", "text", Settings())
    # an array that a lambda looks into must be a variable of it, not an expression inside it
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") <= 3
    got = {r["term"]: r["tf"] for r in terms.collect()}
    assert got["word0"] == 4 and got["word89"] == 3 and got["word0 word1"] == 4 and len(got) == 180


def test_masks_count_common_words_as_sets_do(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(130)]
    rows = [(i, rng.sample(words, rng.randrange(131)), rng.sample(words + ["other"], 40))
            for i in range(30)] + [(30, words, words), (31, [], words), (32, None, words)]
    set_of = Words("x", words)
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>").withColumns(
        {"_a": set_of.masks(F.col("a")), "_b": set_of.masks(F.col("b"))})
    got = df.select("k", *set_of.flat("_a", "a"), *set_of.flat("_b", "b")).select(
        "k", set_of.common("a", "b").alias("n"), set_of.meet("a", "b").alias("any")).collect()
    for r in got:
        _, a, b = rows[r["k"]]
        want = None if a is None else len(set(a) & set(b))
        assert r["n"] == want and (a is None or r["any"] == (want > 0))
    assert Words("x", ()).n == 0


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (-1.0, -0.2), (0.0, 0.0), (0.9999, 1.0)])
def test_the_best_of_groups_are_those_of_all_rows(spark, low, high):
    rng = random.Random(5)
    rows = [(g, i, f"c{i % 50:02}", None if i % 97 == 5 else low + (high - low) * rng.random())
            for g in range(3) for i in range(400)] + [(3, 1, "c", 0.5), (4, 1, "c", None)]
    df = spark.createDataFrame(rows, "jd_id int, row_id long, candidate_id string, final double")
    for k in (1, 10):
        tops = group_tops(df, "jd_id", "row_id", k)
        everyone = normalised_per_group(
            df, "jd_id", tops.withColumn("_cut", F.lit(None).cast("double")))
        want = sorted(map(str, top_per_group(everyone, "jd_id", k).collect()))
        fewer = normalised_per_group(df, "jd_id", tops)
        assert sorted(map(str, top_per_group(fewer, "jd_id", k).collect())) == want
        if (low, high, k) == (0.0, 1.0, 10):
            assert fewer.where("jd_id < 3").count() < 200


def test_blocks_of_roles_hold_few_words(spark, monkeypatch):
    monkeypatch.setattr(rank_many, "BLOCK_WORDS", 3)
    rows = [(4, ["a", "b"]), (1, ["a", "b"]), (2, None), (3, ["c", "d", "e", "f"]), (5, ["b", "g"])]
    none = F.array().cast("array<string>")
    roles = spark.createDataFrame(rows, "jd_id int, keywords array<string>").withColumns(
        dict.fromkeys(("cities", "countries", "excluded"), none))
    got = [[r["jd_id"] for r in block] for block in rank_many._blocks(roles)]
    assert got == [[1, 2], [3], [4, 5]]
