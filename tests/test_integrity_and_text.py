from helpers import c, evaluate, same
from pyspark.sql import functions as F

from rosterlens import Settings
from rosterlens.functions import basics, integrity, phrases

ROW = ("o STRUCT<title: STRING, months: DOUBLE>, n INT, t DOUBLE, z INT, "
       "d STRUCT<title: STRING, months: DOUBLE, span: INT>, y DOUBLE")


def test_reasons_and_verdict(spark):
    rows = [
        (None, 2, 100.0, 0, None, 7.0),
        (("Lead", 100.0), 1, 100.0, 0, None, 2.5),
        (None, 2, 50.0, 0, None, 2.0),
        (None, 1, 500.0, 5, None, 0.0),
        (None, 1, 10.0, 3, None, 9.0),
        (("A", 99.0), 2, 199.0, 6, ("B", 99.0, 12), 1.0),
    ]
    facts = [c(x) for x in ("o", "n", "t", "z", "d", "y")]
    assert evaluate(spark, ROW, rows, integrity.reasons(*facts)) == [
        [],
        ["role 'Lead' lasts 100mo but total experience is only 2.5y"],
        ["career roles sum to 50mo vs 24mo of stated experience (impossible overlap)"],
        ["5 skills marked expert/advanced with 0 months used"],
        ["3 expert/advanced skills with 0 months used"],
        ["role 'A' lasts 99mo but total experience is only 1.0y",
         "career roles sum to 199mo vs 12mo of stated experience (impossible overlap)",
         "6 skills marked expert/advanced with 0 months used",
         "role 'B' claims 99mo over a 12mo date span"]]
    assert evaluate(spark, ROW, rows, integrity.hard_finding(*facts)) == [False, True, True, True, False, True]
    count = integrity.finding_count(*facts)
    assert evaluate(spark, ROW, rows, count) == [0, 1, 1, 1, 1, 4]
    assert same(evaluate(spark, ROW, rows, integrity.soft_penalty(count)),
                [1.0, 0.8, 0.8, 0.8, 0.8, 0.6])


def test_overlong_needs_slack_and_experience(spark):
    rows = [(37.0, 2.0), (36.0, 2.0), (900.0, 0.0), (900.0, None), (None, 2.0)]
    assert evaluate(spark, "m DOUBLE, y DOUBLE", rows, integrity.overlong(c("m"), c("y"))) == \
        [True, False, False, False, False]


def test_dates(spark):
    rows = [("2020-01-01", "2021-01-01"), (None, "2021"), ("20x0", "2021"), ("2020", None)]
    assert evaluate(spark, "a STRING, b STRING", rows, integrity.span_months(c("a"), c("b"))) == \
        [12, None, None, None]
    rows = [(43.0, 12), (42.0, 12), (500.0, None)]
    assert evaluate(spark, "m DOUBLE, s INT", rows, integrity.misdated(c("m"), c("s"))) == \
        [True, False, False]


def test_idle_mastery_null_is_not_zero(spark):
    rows = [("Expert", 0.0), ("advanced", None), ("beginner", 0.0), (None, 0.0)]
    assert evaluate(spark, "p STRING, m DOUBLE", rows, integrity.idle_mastery(c("p"), c("m"))) == \
        [True, False, False, False]


def test_exact_decimals_match_binary_value(spark):
    values = [0.6625, 0.15, 0.25, 0.35, 2.5, 4.35, 6.05, 7.0, 12.45, 0.05, 99.95]
    assert evaluate(spark, "x DOUBLE", [(v,) for v in values], basics.one_decimal(c("x"))) == \
        [f"{v:.1f}" for v in values]
    values = [0.6625, 0.0005, 0.0015, 0.3125, 0.0035, 1.0545, 0.9995, 0.1235, 0.6665, 1.0005, -0.0125, 0.5]
    assert evaluate(spark, "x DOUBLE", [(v,) for v in values], basics.exact_round(c("x"), 3)) == \
        [round(v, 3) for v in values]


def test_grid_rounds_half_to_even(spark):
    import numpy as np
    values = [0.00005, 0.00015, 0.00025, 0.12345, 0.99995]
    assert evaluate(spark, "x DOUBLE", [(v,) for v in values], basics.grid(c("x"), 4)) == \
        [float(np.round(v, 4)) for v in values]


def test_phrases(spark):
    rows = [("Chef", 3.25, "Rome", "Italy", True), (None, None, None, "India", False),
            ("", 1.0, "", "", None)]
    schema = "t STRING, y DOUBLE, l STRING, k STRING, r BOOLEAN"
    assert evaluate(spark, schema, rows, phrases.role_phrase(c("t"), c("y"))) == [
        "Chef with 3.2 yrs", "professional with unknown tenure", "professional with 1.0 yrs"]
    assert evaluate(spark, schema, rows, phrases.location_phrase(
        c("l"), c("k"), c("r"), Settings())) == [
        "Rome (outside India, open to relocate)", "India", "location unknown (outside India)"]


def test_strings_survive_quotes_and_backslashes(spark):
    odd = ["it's", "a\\b", 'say "x"', "l&t"]
    assert spark.range(1).select(basics.strings(odd).alias("a")).first()["a"] == odd


def test_word_edges(spark):
    rows = [("in delhi.",), ("delhis",), ("new delhi",), ("édelhi",)]
    assert evaluate(spark, "t STRING", rows, F.col("t").rlike(basics.as_word("delhi"))) == \
        [True, False, True, False]
