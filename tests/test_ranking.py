import os
import random
import re

import numpy as np
import pytest
from conftest import ROLE_TEXT, person, write_lines
from pyspark.sql import functions as F

from rosterlens import Settings, rank_pool
from rosterlens.operators import audit as views, facts as fx, insights
from rosterlens.operators.jobs import parse_job
from rosterlens.operators.ranking import normalised, top_per_group, top_ranked
from rosterlens.operators.scoring import local_parts, with_reasons
from rosterlens.operators.ordering import grouped_percentiles
from rosterlens.plans import rank_many
from rosterlens.operators.text_features import with_text_features
from rosterlens.sources.candidates import read_jsonl
from rosterlens.sources.scratch import Scratch
from rosterlens.sources.vectors import write_vectors

S = Settings(stop_words=("the", "of"))


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    skilled = [{"name": n, "proficiency": "expert", "duration_months": 0}
               for n in ("NLP", " Ranking ", "retrieval", "embeddings", "nlp")]
    records = [
        person(1), person(2), person(3, location="Berlin", country="Germany"),
        person(4, current_title="Marketing Manager", skills=skilled, career_history=[]),
        person(5, years_of_experience=2), person(6, current_title="Computer Vision Lead"),
        {"candidate_id": "CAND_0000007"},
        person(8, years_of_experience=None, signals={"skill_assessment_scores": {
            "NLP": "90", "excel": True, "word": None, "sql": 40}}),
    ]
    return read_jsonl(spark, write_lines(tmp_path_factory.mktemp("p") / "c.jsonl", records))


@pytest.fixture(scope="module")
def run(people, lexicon):
    return rank_pool(people, ROLE_TEXT, lexicon, S)


def test_ranks_ties_and_scale(run):
    rows = run.top(100).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 9))
    assert rows[0]["score"] == 1.0 and rows[0]["score"] == rows[1]["score"]
    assert [r["candidate_id"] for r in rows[:2]] == ["CAND_0000001", "CAND_0000002"]
    assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:]))


def test_everyone_equals_top(run):
    a = {(r["candidate_id"], r["rank"], r["score"]) for r in run.everyone().collect()}
    assert a == {(r["candidate_id"], r["rank"], r["score"]) for r in run.top(100).collect()}


def test_parts_of_single_rows(run):
    rows = {r["candidate_id"][-1]: r for r in run.parts.collect()}
    assert rows["4"]["mastery_zero"] == 5 and rows["4"]["hard"]
    assert rows["4"]["skill_hits"] == 5 and rows["4"]["stuffer"] < 1.0
    assert rows["4"]["negative"] == 0.6 and rows["4"]["company_type"] == 0.5
    assert rows["5"]["hard"] and rows["5"]["n_reasons"] == 2
    assert rows["6"]["negative"] == 0.6
    assert rows["7"]["evidence"] == 0.0 and rows["7"]["tfidf"] == 0.0
    # text is no number, a boolean counts as one
    assert (rows["8"]["all_n"], rows["8"]["all_sum"], rows["8"]["rel_n"]) == (2, 41.0, 0)
    assert rows["1"]["avg_assessment"] == 90.0
    assert rows["1"]["evidence_terms"] == ["ranking", "retrieval", "ai engineer"]


def test_reasons_are_added_late(run):
    rows = {r["candidate_id"][-1]: r["reasons"] for r in with_reasons(run.top(8)).collect()}
    assert rows["1"] == [] and rows["5"][0].startswith("role 'AI Engineer' lasts 40mo but total")


def test_sentences(run):
    said = {r["candidate_id"][-1]: r["reasoning"] for r in run.top(8).collect()}
    assert said["1"] == ("AI Engineer with 7.0 yrs; strong match to the AI/ML role; profile mentions "
                         "ranking, retrieval, ai engineer; verified assessment avg 90/100; based in "
                         "Pune. Responsive on the platform (response rate 60%).")
    assert "outside India, open to relocate" in said["3"]
    assert "skills list carries relevant keywords" in said["4"]
    assert said["4"].endswith("Concerns: profile has internal inconsistencies.")


def test_audit_and_filters(run, lexicon):
    audit = run.audit()
    assert len(audit.columns) == 22
    flags = {r["candidate_id"][-1]: r["f"] for r in audit.select(
        "candidate_id", views.flag_text().alias("f")).collect()}
    assert flags["4"] == "honeypot" and flags["6"] == "excluded specialty" and flags["1"] == "clean"
    kept = views.filtered(audit, 3, "India", 5).collect()
    assert [r["candidate_id"][-1] for r in kept][:2] == ["1", "2"]
    assert all(r["country"] == "India" and not r["honeypot"] for r in kept)
    assert views.contributions(audit, run.weights).count() == 8 * 6


def test_reweighting_changes_scores_only(run):
    only = run.reweighted({**{k: 0.0 for k in run.weights}, "location": 2.0})
    assert only.weights["location"] == 1.0
    rows = {r["candidate_id"][-1]: r for r in only.parts.collect()}
    assert rows["1"]["base"] == 1.0 and rows["3"]["base"] == 0.35


def test_dense_similarity_is_blended(people, lexicon, spark):
    dense = spark.createDataFrame([("CAND_0000001", -1.0)], "candidate_id STRING, dense DOUBLE")
    rows = {r["candidate_id"][-1]: r for r in
            rank_pool(people, ROLE_TEXT, lexicon, S, dense).parts.collect()}
    assert rows["1"]["semantic"] == 0.5 * rows["1"]["tfidf"] - 0.5
    assert rows["2"]["semantic"] == rows["2"]["tfidf"]


def test_repartitioned_input_gives_the_same_result(people, lexicon, run):
    other = rank_pool(people.repartition(5, "profile"), ROLE_TEXT, lexicon, S)
    pick = ("candidate_id", "rank", "score", "reasoning")
    assert {tuple(r) for r in other.top(8).select(*pick).collect()} == \
        {tuple(r) for r in run.top(8).select(*pick).collect()}


def test_too_few_candidates(people, lexicon):
    with pytest.raises(ValueError, match="only 8 candidates"):
        rank_pool(people, ROLE_TEXT, lexicon, S, at_least=9)


def test_child_tables_give_the_facts_of_nested_records(spark, people, lexicon):
    spec = parse_job(spark, ROLE_TEXT, lexicon, S)
    nested = fx.nested_facts(people, spec, lexicon, S).drop("row_id")
    roles = people.select("candidate_id", F.posexplode("career_history").alias("role_no", "r")) \
        .select("candidate_id", "role_no", "r.*") \
        .withColumns({"start_year": F.substring("start_date", 1, 4).try_cast("int"),
                      "end_year": F.substring("end_date", 1, 4).try_cast("int")})
    owners = people.select("candidate_id", F.col("profile.years_of_experience").alias("yoe"))
    role_facts = fx.role_facts(
        roles.withColumnRenamed("candidate_id", "row_id"),
        owners.withColumnRenamed("candidate_id", "row_id"), lexicon, S).withColumnRenamed(
        "row_id", "candidate_id")
    skills = people.select("candidate_id", F.explode("skills").alias("k")).select("candidate_id", "k.*") \
        .groupBy("candidate_id").agg(*fx.skill_aggregates(spec))
    scores = people.select("candidate_id", F.explode("signals.skill_assessment_scores")
                           .alias("name", "score")) \
        .groupBy("candidate_id").agg(*fx.assessment_aggregates(spec))
    tables = fx.table_facts(owners, [role_facts, skills, scores], "candidate_id", lexicon)
    shared = [n for n in tables.columns if n in nested.columns]
    assert {"past_hits", "overlong", "misdated", "skill_hits", "rel_sum", "n_product"} <= set(shared)

    def plain(df):
        return sorted(map(str, df.select(*shared).collect()))
    assert plain(tables) == plain(nested)


def test_insights(spark):
    rows = [(1, "a", "India", 6.0, 1.0, False, "x"), (2, "b", "India", 5.5, 0.5, True, "x"),
            (3, "c", "Peru", 3.0, 0.25, False, "y"), (4, "d", None, 9.5, 0.0, False, None)]
    df = spark.createDataFrame(
        rows, "rank INT, candidate_id STRING, country STRING, yoe DOUBLE, score DOUBLE, "
              "honeypot BOOLEAN, title STRING")
    assert tuple(insights.kpis(df, "India").first()) == (4, 50, 1, 6.0)
    assert [tuple(r) for r in insights.most_common(df, "title", 12).collect()] == [("x", 2), ("y", 1)]
    assert {tuple(r) for r in insights.experience_bands(df).collect()} == {
        ("6-8", 1), ("5-9", 1), ("<5", 1), ("9+", 1)}
    assert {tuple(r) for r in insights.histogram(df, "score", 4).collect()} == {
        (0, 1), (1, 1), (2, 1), (3, 1)}
    assert tuple(insights.score_range(df).first()) == (0.0, 1.0, 1)
    assert [r["rank"] for r in insights.leaders(df, 2).collect()] == [1, 2]


def test_all_zero_scores(spark):
    df = spark.createDataFrame([(1, "b", 0.0), (2, "a", 0.0)], "row_id INT, candidate_id STRING, final DOUBLE")
    assert [(r["candidate_id"], r["score"]) for r in top_ranked(normalised(df), 5).collect()] == [
        ("a", 0.0), ("b", 0.0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_owner_is_merged_before_it_meets_its_roles(spark, lexicon):
    """One owner has a third of all roles; of these leave as many rows as there are durations."""
    roles = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("row_id"),
        F.col("id").alias("role_no"), F.concat(F.lit("developer "), "id").alias("title"),
        F.lit("Acme").alias("company"), F.lit("Software").alias("industry"),
        (F.col("id") % 2 == 0).alias("is_current"),
        (F.col("id") % 50).cast("double").alias("duration_months"),
        F.lit(2010).alias("start_year"), F.lit(2011).alias("end_year"))
    owners = roles.select("row_id").distinct().withColumn("yoe", F.lit(2.5))
    merged = fx._per_duration(roles, lexicon, S, (), ())
    assert merged.where("row_id = 0").count() == 50
    plan = plan_of(fx.role_facts(roles, owners, lexicon, S))
    assert "partial_count" in plan and "hashpartitioning(row_id" in plan
    got = fx.role_facts(roles, owners, lexicon, S).where("row_id = 0").first()
    assert (got["n_roles"], got["n_product"], got["n_completed"]) == (10_000, 10_000, 5_000)
    assert got["total_months"] == sum(i % 50 for i in range(0, 30_000, 3))
    assert got["past_hits"] == [0, 5_000, 0, 0]
    # longer than 2.5 years and a year: 43 months and more, first in the order of the roles
    assert got["overlong"].title == "developer 45" and got["misdated"].title == "developer 45"


def exchanged(df):
    """Output columns of every exchange of a plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)


def test_no_exchange_carries_a_text(spark, people, lexicon):
    """The run writes tables; the plans that write them are caught and looked at."""
    plans, write = [], Scratch.keep
    try:
        Scratch.keep = lambda self, df, *by: (plans.append(df), write(self, df, *by))[1]
        with rank_pool(people, ROLE_TEXT, lexicon, S) as run:
            ranks = run.ranks()
            plans += [ranks, run.top(3)]
            sent = [column for df in plans for columns in exchanged(df)
                    for column in columns.split(", ")]
            widest = max(columns.count(",") + 1 for columns in exchanged(plans[-3]))
    finally:
        Scratch.keep = write
    assert len(plans) >= 7 and sent
    assert not [x for x in sent if re.match("(prose|terms|_u|_s|_b|value)#", x)]
    assert widest <= 4   # what is sorted to rank everything


def test_a_closed_run_leaves_nothing(people, lexicon):
    with rank_pool(people, ROLE_TEXT, lexicon, S) as run:
        folder = run.scratch.folder.removeprefix("file:")
        assert run.top(3).count() == 3 and len(os.listdir(folder)) == 1
        assert run.reweighted({**S.weights, "role_fit": 1.0}).top(2).count() == 2
    assert not os.path.exists(folder)


def test_vectors_are_taken_from_their_artifact(spark, people, lexicon, run, tmp_path):
    rows = [("CAND_0000001", [1.0, 1.0]), ("CAND_0000002", [0.0, 3.0])]
    write_vectors(spark.createDataFrame(rows, "id string, vector array<double>"), [0.0, 2.0],
                  str(tmp_path / "v"))
    with rank_pool(people, ROLE_TEXT, lexicon, S, vectors=str(tmp_path / "v")) as near:
        got = {r["candidate_id"][-1]: (r["semantic"], r["tfidf"]) for r in near.parts.collect()}
    assert got["2"][0] == pytest.approx(0.5 * got["2"][1] + 0.5)
    assert got["1"][0] == pytest.approx(0.5 * got["1"][1] + 0.5 / 2 ** 0.5)
    assert got["3"][0] == got["3"][1]
    with rank_pool(people, ROLE_TEXT, lexicon, S, vectors=str(tmp_path / "none")) as plain:
        pick = ("candidate_id", "rank", "score")
        assert plain.top(8).select(*pick).collect() == run.top(8).select(*pick).collect()


def test_plans(run, spark, people, lexicon):
    assert "TakeOrderedAndProject" in plan_of(run.top(5))
    assert "WindowGroupLimit" in plan_of(top_per_group(run.scores, "country", 2))
    spec = parse_job(spark, ROLE_TEXT, lexicon, S)
    facts = with_text_features(fx.nested_facts(people, spec, lexicon, S), "prose", lexicon,
                               spec.keywords, S)
    local = plan_of(local_parts(facts, spec, lexicon, S))
    assert "hashpartitioning" not in local and "Python" not in local
    for df in (run.top(5), run.everyone(), run.audit(3)):
        text = plan_of(df)
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text


MORE_ROLES = (ROLE_TEXT, "Role: Marketing Manager\n3 years. SEO campaign for stakeholder groups.",
              "Cook wanted", "Position: Software Developer\nminimum 4 years in Germany. Api, "
              "rest api, database, React. We avoid marketing.", "Product manager: roadmap, scrum")


def test_many_roles_equal_single_runs(spark, people, lexicon, monkeypatch):
    monkeypatch.setattr(rank_many, "ROLE_BLOCK", 2)
    jobs = spark.createDataFrame(list(enumerate(MORE_ROLES)), "jd_id long, text string")
    dense = spark.createDataFrame([("CAND_0000003", 0.7)], "candidate_id string, dense double")
    for near in (None, dense):
        got = {}
        for r in rank_many.rank_pool_for_roles(people, jobs, lexicon, S, 5, near).collect():
            got.setdefault(r["jd_id"], []).append((r["rank"], r["candidate_id"], r["score"]))
        for i, text in enumerate(MORE_ROLES):
            with rank_pool(people, text, lexicon, S, near) as alone:
                want = alone.top(5).select("rank", "candidate_id", "score").collect()
            assert sorted(got[i]) == sorted(tuple(r) for r in want), text
    assert rank_many.rank_pool_for_roles(people, jobs.limit(0), lexicon, S).count() == 0
    with pytest.raises(ValueError, match="one by one"):
        rank_many.rank_pool_for_roles(people, jobs, lexicon, Settings(max_features=10))


def test_percentiles_of_groups(spark):
    rng = random.Random(1)
    groups = {g: [rng.choice([0.0, rng.random(), 0.5]) for _ in range(57)] for g in range(6)}
    groups[6], groups[7] = [0.0] * 56 + [0.3], [0.25] * 57
    rows = [(g, v) for g, values in groups.items() for v in values if v > 0]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    for p in (99, 100, 50, 0, 12.5):
        got = {r["g"]: r["value"] for r in grouped_percentiles(
            df, "g", "v", F.lit(57), F.lit(float(p))).collect()}
        assert got == {g: pytest.approx(float(np.percentile(v, p)), abs=1e-15)
                       for g, v in groups.items()}
