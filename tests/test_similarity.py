import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens import Settings
from rosterlens.operators import tfidf
from rosterlens.operators.dense import dense_cosine, one_per_key
from rosterlens.operators.ordering import exact_percentile, number_rows
from rosterlens.operators.text_features import of_pool, stop_words, with_terms, with_text_features
from rosterlens.operators.tfidf import percentile_scaled, similarities
from rosterlens.sources.scratch import Scratch

STOP = ("the", "of")
TEXTS = ["The cost of data data pipelines", "data pipelines and ranking", "", "zzz",
         "ranking of ranking models", "Élan élan data_set data_set x 42", "pipelines cost"]
QUERY = "ranking data pipelines of élan cost"


def brute_force(texts, query, min_df=2, cap=None):
    def terms(text):
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    docs = [terms(t) for t in texts + [query]]
    df, cf = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        cf.update(d)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t))[:cap]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    rows = [{t: (1 + math.log(n)) * idf[t] for t, n in d.items() if t in idf} for d in docs]
    def unit(r):
        n = math.sqrt(sum(x * x for x in r.values()))
        return {t: x / n for t, x in r.items()} if n else {}
    q = unit(rows[-1])
    return [sum(x * q.get(t, 0.0) for t, x in unit(r).items()) for r in rows[:-1]]


@pytest.mark.parametrize("cap", [None, 40000, 4])
def test_tfidf_equals_brute_force(spark, cap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k INT, t STRING").repartition(3)
    settings = Settings(stop_words=STOP, max_features=cap)
    got = similarities(with_terms(df, "t", STOP), "k", QUERY, settings)
    values = [r["tfidf"] for r in got.orderBy("k").collect()]
    assert np.allclose(values, brute_force(TEXTS, QUERY, cap=cap), atol=1e-12)


def test_default_stop_words(spark):
    df = spark.createDataFrame([(1, "the the and"), (2, "the pear")], "k INT, t STRING")
    got = similarities(with_terms(df, "t", stop_words(Settings())), "k", "the and", Settings())
    assert [r["tfidf"] for r in got.collect()] == [0.0, 0.0]


@pytest.mark.parametrize("n,p", [(1, 99), (2, 99), (49, 99), (101, 99), (100, 50), (37, 12.5),
                                 (60, 100), (60, 0)])
def test_exact_percentile(spark, n, p):
    rng = random.Random(n)
    values = [rng.choice([0.0, rng.random()]) for _ in range(n)]  # a third and more ties
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE").repartition(5)
    row = exact_percentile(df, "x", p).first()
    assert row["n"] == n
    assert math.isclose(row["value"], float(np.percentile(values, p)), abs_tol=1e-15)


def test_percentile_scaling_small_and_zero(spark):
    few = spark.createDataFrame([(1, 0.2), (2, 0.4)], "k INT, x DOUBLE")
    assert [r["y"] for r in percentile_scaled(few, "x", "y", Settings()).orderBy("k").collect()] == [0.5, 1.0]
    none = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k INT, x DOUBLE")
    assert [r["y"] for r in percentile_scaled(none, "x", "y", Settings()).collect()] == [0.0, 0.0]


def test_number_rows_with_a_hot_value(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11)
                                 .alias("v"), "id").repartition(7)
    rows = number_rows(df, "pos", F.desc("v"), F.asc("id")).collect()
    want = sorted(((r["v"], r["id"]) for r in rows), key=lambda t: (-t[0], t[1]))
    assert [(r["v"], r["id"]) for r in sorted(rows, key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in rows) == list(range(1, 501))


def test_dense_cosine(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("a", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id STRING, v ARRAY<FLOAT>")
    got = {(r["id"], round(r["dense"], 6)) for r in dense_cosine(df, "id", "v", [2.0, 0.0]).collect()}
    assert got == {("a", 1.0), ("b", 0.707107), ("c", 0.0), ("a", 0.707107)}
    once = one_per_key(dense_cosine(df, "id", "v", [2.0, 0.0]), "id").collect()
    assert sorted(r["id"] for r in once) == ["a", "b", "c"]


def test_text_features_replace_the_text(spark, lexicon):
    rows = [(1, "machine learning and a rest api; api"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "k INT, t STRING")
    got = {r["k"]: r for r in with_text_features(
        df, "t", lexicon, ("api", "learning", "none"), Settings(stop_words=("and",))).collect()}
    assert "t" not in got[1].asDict()
    assert got[1]["term_hits"] == [1, 2, 0, 0] and got[1]["found"] == ["api", "learning"]
    assert {(x["term"], x["tf"]) for x in got[1]["terms"]} == {
        ("machine", 1), ("learning", 1), ("rest", 1), ("api", 2), ("machine learning", 1),
        ("learning rest", 1), ("rest api", 1), ("api api", 1)}
    for k in (2, 3):
        assert got[k]["term_hits"] == [0] * 4 and got[k]["found"] == [] and got[k]["terms"] == []


def _table(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_not_exchanged_to_meet_the_pool_or_a_capped_vocabulary(spark, tmp_path):
    rows = [(i * 7919 % 1_000_003, [(f"w{i % 500}", 1), (f"x{i}", 2), ("hot", 1)]) for i in range(20_000)]
    texts = _table(spark, tmp_path / "t", rows, "k long, terms array<struct<term:string,tf:int>>")
    pool = _table(spark, tmp_path / "p", [(r[0],) for r in rows[3:]], "k long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        with Scratch(spark) as scratch:
            known = of_pool(texts, pool, "k", scratch)
            assert "SortMergeJoin" not in _plan(known)
            got = similarities(texts, "k", "hot w7 w8", Settings(max_features=50), None, scratch)
            assert "SortMergeJoin [term" not in _plan(got)
            assert known.count() == len(rows) - 3 and got.where("tfidf > 0").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_an_uncapped_vocabulary_is_met_whole_beyond_its_common_terms(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i * j % 17}" for j in range(1, 9))) for i in range(60)]
    df = with_terms(spark.createDataFrame(rows, "k int, t string"), "t", STOP)
    want = {r["k"]: r["tfidf"] for r in similarities(
        df, "k", "w3 w4 w6 w16", Settings(max_features=10_000)).collect()}
    monkeypatch.setattr(tfidf, "COMMON_TERMS", 3)
    got = {r["k"]: r["tfidf"] for r in similarities(
        df, "k", "w3 w4 w6 w16", Settings(max_features=None)).collect()}
    assert got == pytest.approx(want, rel=1e-12) and max(want.values()) > 0


def test_counts_of_terms_follow_their_sorted_order(spark):
    df = spark.createDataFrame([(1, "bb aa bb bb"), (2, ""), (3, None), (4, "zz")], "k int, t string")
    got = {r["k"]: [tuple(x) for x in r["terms"]] for r in with_terms(df, "t", ()).collect()}
    assert got == {1: [("aa", 1), ("aa bb", 1), ("bb", 3), ("bb aa", 1), ("bb bb", 1)], 2: [], 3: [],
                   4: [("zz", 1)]}
