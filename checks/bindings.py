"""The given tables seen as candidates, roles, skills, signals and role texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.parameters import LEXICON, ROLE_HEAD, SETTINGS
from rosterlens.functions.scores import bare_name
from rosterlens.operators import facts as fx
from rosterlens.operators.dense import dense_cosine
from rosterlens.operators.text_features import with_text_features
from rosterlens.plans.rank_many import NO_ROLE
from rosterlens.settings import JobSpec
from rosterlens.sources.scratch import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candidate_id(key: str) -> Column:
    return F.format_string("CAND_%07d", F.col(key).cast("bigint"))


def years(key: Column) -> Column:
    return (key % 160) / F.lit(10.0)


def people(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer: profile and platform signals."""
    events = table(spark, sf, "events")
    users = events.agg((F.max("user_id") + 1).alias("n")).scalar()
    signals = events.groupBy("user_id").agg(
        F.avg((F.col("event_type") == "click").cast("double")).alias("click_rate"),
        F.avg((F.col("event_type") == "purchase").cast("double")).alias("buy_rate"),
        F.max((F.col("event_type") == "signup") & (F.col("value") > 100)).alias("open_to_work"))
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"),
        F.lower("p_type").alias("industry"))
    key = F.col("row_id")
    return (
        table(spark, sf, "customer").withColumnRenamed("c_custkey", "row_id")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(part, "row_id", "left")
        .withColumn("user_id", key % users)
        .join(signals, "user_id", "left")
        .select(
            key, candidate_id("row_id").alias("candidate_id"), "title", "industry",
            F.col("c_mktsegment").alias("company"),
            years(key).alias("yoe"),
            F.lower("n_name").alias("location"), F.lower("r_name").alias("country"),
            (key % 3 == 0).alias("relocate"), F.coalesce("open_to_work", F.lit(False))
            .alias("open_to_work"),
            (key % 2 == 0).alias("email_ok"), (key % 4 == 0).alias("phone_ok"),
            F.when(key % 11 > 0, F.col("click_rate") * 2.0).alias("response_rate"),
            F.when(key % 13 > 0, F.col("buy_rate")).alias("interview_rate"),
            F.when(key % 17 > 0, (key % 121).cast("double")).alias("notice_days"),
            F.when(key % 7 > 0, (key % 101).cast("double")).alias("completeness"),
            F.when(key % 5 > 0, (key % 100).cast("double")).otherwise(-1.0).alias("github"),
            "user_id"))


def prose(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.lower("text").alias("prose"))


def roles(spark: SparkSession, sf: str, spec: JobSpec) -> DataFrame:
    """One row per order, with the skill counts of its lines already summed."""
    order = F.col("o_orderkey")
    began = F.year(F.min("o_orderdate"))
    running = F.min("o_orderstatus") == "O"
    lines = (table(spark, sf, "lineitem")
             .join(table(spark, sf, "orders"), F.col("l_orderkey") == order)
             .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
             .withColumns({
                 "name": F.col("p_name"),
                 "proficiency": F.when(F.col("l_returnflag") == "A", "expert")
                 .when(F.col("l_returnflag") == "N", "advanced").otherwise("beginner"),
                 "duration_months": F.col("l_quantity").cast("bigint") % 5}))
    return (lines.groupBy(F.col("o_custkey").alias("row_id"), order.alias("role_no")).agg(
        F.min("p_name").alias("title"),
        F.concat(F.lit("supplier "), F.min("l_suppkey").cast("string")).alias("company"),
        F.lower(F.min("p_type")).alias("industry"),
        running.alias("is_current"), began.alias("start_year"),
        F.when(~running, began + (order % 4).cast("int")).alias("end_year"),
        F.max("o_orderdate").alias("ordered"), *fx.skill_aggregates(spec))
        .withColumn("duration_months", (1 + F.col("role_no") % 60).cast("double")))


def role_facts(spark: SparkSession, sf: str, spec: JobSpec) -> DataFrame:
    """Role and skill facts per customer in one pass over the lines."""
    own = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), years(F.col("c_custkey")).alias("yoe"))
    found = fx.role_facts(roles(spark, sf, spec), own, LEXICON, SETTINGS,
                          sums=("skill_hits", "mastery_zero"), latest=("ordered",))
    return found.withColumn("last_active", F.date_format("ordered", "yyyy-MM-dd")).drop("ordered")


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    """Score of each user by name of the assessment."""
    return (table(spark, sf, "events").where(F.col("event_type") != "error")
            .groupBy("user_id", F.col("event_type").alias("name"))
            .agg(F.least(F.lit(100.0), F.avg("value")).alias("score")))


def assessment_facts(spark: SparkSession, sf: str, spec: JobSpec) -> DataFrame:
    return assessments(spark, sf).groupBy("user_id").agg(*fx.assessment_aggregates(spec))


def text_features(spark: SparkSession, sf: str, keywords) -> DataFrame:
    """What is read from the documents, written in the stage that scans them."""
    return materialise(with_text_features(prose(spark, sf), "prose", LEXICON, keywords, SETTINGS))


def pool(spark: SparkSession, sf: str, spec: JobSpec, features: DataFrame) -> DataFrame:
    """Facts of every customer, with the narrow features of their texts."""
    own = people(spark, sf).join(assessment_facts(spark, sf, spec), "user_id", "left")
    return fx.table_facts(
        own, [role_facts(spark, sf, spec), features.select("row_id", "term_hits", "found")],
        "row_id", LEXICON).drop("user_id")


def pool_for_roles(spark: SparkSession, sf: str, keywords: tuple[str, ...],
                   features: DataFrame) -> DataFrame:
    """Facts of every customer for many roles: skills and assessments by name, where a role asks.

    A customer has at most one entry for each keyword, whatever its number of lines.
    """
    named = (table(spark, sf, "lineitem")
             .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
             .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
             .groupBy(F.col("o_custkey").alias("row_id"), bare_name(F.col("p_name")).alias("name"))
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("name").isin(*keywords)))
    skills = named.groupBy("row_id").agg(F.collect_list(F.struct("name", "n")).alias("skill_counts"))
    every = assessment_facts(spark, sf, NO_ROLE).drop("rel_n", "rel_sum")
    scores = assessments(spark, sf).where(F.col("name").isin(*keywords)).groupBy("user_id").agg(
        F.collect_list(F.struct("name", "score")).alias("assessed"))
    own = people(spark, sf).join(every, "user_id", "left").join(scores, "user_id", "left")
    return fx.table_facts(own, [
        role_facts(spark, sf, NO_ROLE).drop("skill_hits"), skills,
        features.select("row_id", "term_hits", "found")], "row_id", LEXICON).drop("user_id")


def role_text(spark: SparkSession, sf: str) -> str:
    """The one role text of the run."""
    item = table(spark, sf, "benchmark").where("item_id = 0").select("text").first()
    return ROLE_HEAD + item["text"]


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of every stored vector with vector 0, keyed by candidate."""
    vectors = table(spark, sf, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").first()["embedding"]
    return dense_cosine(
        vectors.withColumn("candidate_id", candidate_id("vec_id")),
        "candidate_id", "embedding", query)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One role text per part."""
    size = F.col("p_size")

    def said(col: Column) -> Column:
        return col.cast("string")

    key = F.col("p_partkey")
    years = (F.when(key % 5 == 0, F.concat(said(size % 9), F.lit("-"), said(size % 9 + 4),
                                           F.lit(" years")))
             .when(key % 5 == 1, F.concat(F.lit("minimum "), said(size), F.lit(" years")))
             .when(key % 5 == 2, F.concat(said(size), F.lit("+ years")))
             .when(key % 5 == 3, F.concat(said(size), F.lit(" years")))
             .otherwise("any tenure"))
    place = F.when(key % 3 == 0, "asia").when(key % 3 == 1, "europe").otherwise("nowhere")
    city = F.when(key % 4 == 0, " nation_1, nation_13").otherwise("")
    words = F.concat(F.lit(" Skills for this: "), F.col("p_brand"), F.lit(" from that "),
                     F.lower("p_type"), F.lit(" hot "), F.substring_index("p_name", " ", -1))
    text = F.concat(
        F.lit("Role: "), F.col("p_name"), F.lit("\n"), years, F.lit(". In "), place, city,
        F.lit("."), words, F.lit("\nWe do NOT want: "), F.lower("p_type"), F.lit(" work; "),
        F.when(key % 2 == 0, "or gizmo").otherwise("or gear"), F.lit("."))
    return table(spark, sf, "part").select(key.alias("jd_id"), text.alias("text"))
